"""Best-fit packing of documents into fixed-length sequences by a grouping genetic algorithm.

A document is its token ids and one end id. Only a document longer than a sequence is cut,
into pieces of full length and a rest. Full pieces fill a sequence of their own; the others are
packed so that as few sequences as possible are used.

The pieces are dealt into blocks of bounded size by a hash of a row number, so a repeated key
makes no block larger. In each block a few islands evolve a population of groupings. A child
takes well-filled bins of one parent whole into the other, the bins that then hold an item twice
are dissolved, and what they lose is best-fitted again, the longest first. After each epoch the
best groupings of an island migrate to the next one. A block stops early where it
uses no more sequences than its tokens need. The badly filled sequences of all blocks are then
opened and packed together in fewer blocks, until one block holds them, so that a block's
last, part-filled sequence costs nothing at any size.

Items of equal length can stand for each other, so the evolution sees lengths only; the rows
are told apart again when the best grouping of a block is written out. Islands, epochs and
rounds are stored in the shared folder.

Null texts count as empty: such a document is one end id. Repeated rows are packed each. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tillcast.llm.common import kept
from tillcast.llm.tokens import Memo, Words
from tillcast.session import materialize

#: Items of a block, islands of a block, epochs between which elites migrate.
BLOCK_ITEMS = 4096
ISLANDS = 2
EPOCHS = 2
#: Children of an island in an epoch, groupings it keeps, share of a bin that counts as well filled.
CHILDREN = 16
KEPT = 4
WELL_FILLED = 0.995


class Encoder(Words):
    """Ids of texts as little-endian bytes, by the library's own merging of each word piece."""

    def __init__(self, path: str, memo_bytes: int | None = None):
        super().__init__(path)
        self._tokenize = self.library.model.tokenize
        self._kept = Memo(memo_bytes)

    def _piece(self, piece: str | int) -> bytes:
        if isinstance(piece, int):
            return np.array([piece], "<u4").tobytes()
        key = "\n" + piece  # no word holds a line end, so pieces have keys of their own
        ids = self._kept.get(key)
        if ids is None:
            ids = self._merged(piece)
            self._kept.put(key, ids)
        return ids

    def _merged(self, piece: str) -> bytes:
        return np.array([t.id for t in self._tokenize(piece)], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        ids = self._kept.get(word)
        if ids is None:
            parts = self.pieces(word)
            whole = len(parts) == 1 and isinstance(parts[0], str)  # kept as a word only
            ids = self._merged(parts[0]) if whole else b"".join(map(self._piece, parts))
            self._kept.put(word, ids)
        return ids

    def encode(self, text: str | None) -> bytes:
        kept = self._kept.young
        words = (text or "").replace("\n", " ").split(" ")
        return b"".join([ids if (ids := kept.get(w)) is not None else self._word(w) for w in words if w])


@kept
def encoder(path: str, memo_bytes: int | None = None) -> Encoder:
    """This worker's encoder; ``memo_bytes`` bounds each of its memo's two generations."""
    return Encoder(path, memo_bytes)


def pieces(documents: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, memo_bytes: int | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document cut only where it is too long."""
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, memo_bytes)
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column("text")):
                ids = own.encode(text.as_py()) + end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    at.append(row)
                    piece.append(k // (4 * capacity))
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()),
                 *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        own._kept.trim()

    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Block:
    """Groupings of one block's items into bins; items are numbered from the longest down."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: int):
        self.lengths, self.capacity = lengths, capacity
        self.least = -(-int(lengths.sum()) // capacity)
        self.random = np.random.default_rng(seed)

    def loads(self, bins: np.ndarray) -> np.ndarray:
        return np.bincount(bins, weights=self.lengths, minlength=int(bins.max()) + 1).astype(np.int64)

    def fitness(self, bins: np.ndarray) -> tuple[int, float]:
        """Fewer bins first, then fuller ones."""
        load = self.loads(bins)
        return -len(load), float(((load / self.capacity) ** 2).sum())

    def fit(self, bins: np.ndarray, free_items: np.ndarray) -> np.ndarray:
        """Put each item into the open bin that it fills best, or into a new one, in the given order."""
        held = bins >= 0
        n = int(bins.max()) + 1 if held.any() else 0
        room = (self.capacity - np.bincount(bins[held], weights=self.lengths[held], minlength=n)).astype(int).tolist()
        at: dict[int, list[int]] = {}
        open_ = 0  # bit r is set if some bin has r free places
        for b, r in enumerate(room):
            if r:
                at.setdefault(r, []).append(b)
                open_ |= 1 << r
        for i in free_items.tolist():
            size = int(self.lengths[i])
            fits = open_ >> size
            if fits:
                r = size + (fits & -fits).bit_length() - 1
                b = at[r].pop()
                if not at[r]:
                    open_ ^= 1 << r
                r -= size
            else:
                b, r = n, self.capacity - size
                n += 1
            bins[i] = b
            if r:
                at.setdefault(r, []).append(b)
                open_ |= 1 << r
        return np.unique(bins, return_inverse=True)[1].astype(np.uint16)

    def first(self, noise: float) -> np.ndarray:
        """Best fit of the items in falling, slightly disturbed order."""
        order = np.argsort(-(self.lengths * (1 + noise * self.random.random(len(self.lengths)))), kind="stable")
        return self.fit(np.full(len(self.lengths), -1, np.int64), order)

    def child(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Well-filled bins of b go whole into a; what they displace there is best-fitted."""
        full = np.flatnonzero(self.loads(b) >= WELL_FILLED * self.capacity)
        chosen = full[self.random.random(len(full)) < self.random.uniform(0.1, 0.6)]
        injected = np.isin(b, chosen)
        load_a = self.loads(a)
        broken = np.zeros(len(load_a), bool)
        broken[a[injected]] = True  # these would hold an item twice
        poor = np.argsort(load_a, kind="stable")[: max(2, len(load_a) // 50)]
        broken[poor] = True
        bins = a.astype(np.int64)
        bins[broken[a]] = -1
        bins[injected] = len(load_a) + b[injected].astype(np.int64)
        held = bins >= 0
        bins[held] = np.unique(bins[held], return_inverse=True)[1]
        loose = np.flatnonzero(~held)
        return self.fit(bins, loose[np.argsort(-self.lengths[loose], kind="stable")])

    def evolve(self, start: list[np.ndarray], children: int) -> list[np.ndarray]:
        seen = start or [self.first(0.0)]
        while len(seen) < KEPT and -self.fitness(seen[0])[0] > self.least:
            seen.append(self.first(self.random.uniform(0.02, 0.3)))
        ranked = sorted(((self.fitness(x), x) for x in seen), key=lambda p: p[0], reverse=True)
        for _ in range(children):
            if -ranked[0][0][0] <= self.least or len(ranked) < 2:
                break
            a, b = self.random.choice(len(ranked), 2, replace=False)
            grown = self.child(ranked[a][1], ranked[b][1])
            ranked.append((self.fitness(grown), grown))
            ranked = sorted(ranked, key=lambda p: p[0], reverse=True)[: KEPT + 2]
        return [x for _, x in ranked[:KEPT]]


def _epoch(states: DataFrame, capacity: int, children: int, epoch: int) -> DataFrame:
    """One epoch of every island; ``elites`` holds its groupings and those that came to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()  # all texts are encoded: the words that this worker has kept can go
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], np.uint16).astype(np.int64)
                own = Block(lengths, capacity, (row["block"] * 31 + row["island"]) * 31 + epoch)
                best = own.evolve([np.frombuffer(x, np.uint16) for x in row["elites"]], children)
                bins, fill = own.fitness(best[0])
                out.append(row | {"elites": [x.tobytes() for x in best], "score": float(bins) + fill / (len(lengths) + 1)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("block", pa.int64()), ("island", pa.int32()), ("lengths", pa.binary()),
                ("elites", pa.list_(pa.binary())), ("score", pa.float64()),
            ]))

    return states.mapInArrow(run, "block long, island int, lengths binary, elites array<binary>, score double")


def _solve(items: DataFrame, blocks: int, capacity: int, islands: int, epochs: int, children: int) -> DataFrame:
    """(block, item, length, bin, load) of the best grouping found for every block."""
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        lengths = np.sort(table.column("length").to_numpy().astype(np.uint16))[::-1]
        return pa.table({"block": [key[0].as_py()], "lengths": [lengths.tobytes()]})

    gathered = dealt.select("block", "length").groupBy("block").applyInArrow(gather, "block long, lengths binary")
    states = gathered.select(
        "block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths",
        F.array().cast("array<binary>").alias("elites"),
    ).repartition("block", "island")
    states = materialize(_epoch(states, capacity, children, 0), "islands")
    for epoch in range(1, epochs if islands > 1 else 1):
        came = states.select("block", ((F.col("island") + 1) % islands).alias("island"), F.col("elites").alias("came"))
        joined = states.join(came, ["block", "island"]).select(
            "block", "island", "lengths",
            F.concat(F.slice("elites", 1, KEPT // 2), F.slice("came", 1, KEPT // 2)).alias("elites"),
        )
        states = materialize(_epoch(joined, capacity, children, epoch), "islands")
    best = states.groupBy("block").agg(F.max_by(F.element_at("elites", 1), "score").alias("bins"))

    def place(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        lengths = left.column("length").to_numpy()
        order = np.lexsort((left.column("item").to_numpy(), -lengths))  # the longest first, as gathered
        bins = np.frombuffer(right.column("bins")[0].as_py(), np.uint16).astype(np.int64)
        sizes, held = lengths[order], left.column("item").to_numpy()[order]
        load = np.bincount(bins, weights=sizes).astype(np.int64)
        inside = np.lexsort((np.arange(len(bins)), bins))
        before = np.cumsum(sizes[inside]) - sizes[inside]
        first = np.concatenate([[True], np.diff(bins[inside]) > 0])
        offset = np.empty(len(bins), np.int64)
        offset[inside] = before - np.maximum.accumulate(np.where(first, before, 0))
        return pa.table({"block": np.full(len(bins), key[0].as_py()), "item": held, "length": sizes, "bin": bins, "load": load[bins], "offset": offset})

    return dealt.groupBy("block").cogroup(best.groupBy("block")).applyInArrow(
        place, "block long, item long, length long, bin long, load long, offset long"
    )


def pack(
    pieces_: DataFrame, capacity: int = 2048, block_items: int = BLOCK_ITEMS,
    islands: int = ISLANDS, epochs: int = EPOCHS, children: int = CHILDREN,
) -> DataFrame:
    """Add (sequence_id, offset) to rows that have a ``length`` of 1 to ``capacity``."""
    stored = materialize(pieces_.withColumn("item", F.monotonically_increasing_id()), "pieces")
    full = stored.where(F.col("length") == capacity).select(
        "*", (-F.col("item") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    open_ = stored.where(F.col("length") < capacity).select("item", "length")
    count, done, level = open_.count(), [], 0
    while count:
        blocks = -(-count // block_items)
        solved = materialize(_solve(open_, blocks, capacity, islands, epochs, children), "packed")
        last = blocks == 1
        closed = solved if last else solved.where(F.col("load") >= WELL_FILLED * capacity)
        done.append(closed.select(
            "item", (F.lit(level << 56) + F.col("block") * (1 << 16) + F.col("bin")).alias("sequence_id"), "offset"
        ))
        if last:
            break
        open_ = solved.where(F.col("load") < WELL_FILLED * capacity).select("item", "length")
        left = open_.count()
        if left > 0.9 * count:
            # what fills badly everywhere gains nothing from another deal but in each block's worst
            # bin: the others close as they are, and the worst bins' items meet on the next level
            worst = solved.groupBy("block").agg(F.min(F.struct("load", "bin")).alias("worst"))
            marked = solved.join(worst, "block").withColumn("carried", F.col("bin") == F.col("worst.bin"))
            done[-1] = marked.where("not carried").select(
                "item", (F.lit(level << 56) + F.col("block") * (1 << 16) + F.col("bin")).alias("sequence_id"), "offset"
            )
            open_ = materialize(marked.where("carried").select("item", "length"), "carried")
            left = open_.count()
        count, level = left, level + 1
    if not done:
        return full.drop("item")
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    packed = stored.where(F.col("length") < capacity).join(placed, "item")
    return full.unionByName(packed.select(full.columns)).drop("item")


def packed_documents(documents: DataFrame, path: str, capacity: int = 2048, memo_bytes: int | None = None, **options) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all documents."""
    return pack(pieces(documents, path, capacity, memo_bytes=memo_bytes), capacity, **options)
