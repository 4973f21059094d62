"""Language-model scores: stupid backoff over token pairs, counted over all documents.

Documents are gathered into blocks of bounded size. Every block explodes its token pairs, keeps
each one once with its count, and deals them out by hash. In each hash part the blocks'
counts add up to the table of pair counts, which is joined back to the pairs of every block there, and each
block scores its documents from the totals it gets back. So what moves grows with the different
pairs of the blocks and not with all pairs, and a frequent pair is one row a block at most.
The counts of single tokens, at most one number for each vocabulary entry, go to all tasks.

A document's own counts are left out of what it is scored with; a document does not vouch for itself. With
those counts c, S(w | v) = c(v w) / c(v) where the pair is seen, else ``backoff`` * c(w) / N, and
``backoff`` / N for a token seen nowhere else. The first token is scored as a single token.

Null and empty texts have no tokens and a null mean. Rows that repeat are scored each, and a
copy counts as another document. Texts are scored whole. Empty tables give no rows. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tillcast.llm.common import forget, give_back, mix
from tillcast.llm.packing import encoder
from tillcast.session import materialize

BACKOFF = 0.4
#: Tokens after which a block is closed, about 60 bytes each while it is scored, and pairs of a hash part that are aimed at.
BLOCK_TOKENS = 1_000_000
PART_PAIRS = 2_000_000
#: Tokens of a block that are scored at once, whole documents each.
SLICE_TOKENS = 250_000
#: Bytes of each of the memo's two generations: less than for packing, as the blocks and, from earlier
#: stages, the JVM's heap stand beside it in an executor.
MEMO_BYTES = 32 << 20


def blocks(documents: DataFrame, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(block, doc_ids, ids, ends): the tokens of all documents, stored."""
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        own, closed, held = encoder(path, MEMO_BYTES), 0, 0
        if own.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits: the vocabulary has more than 65,536 entries")
        names, parts, sizes = [], [], []

        def close() -> pa.RecordBatch:
            block = TaskContext.get().partitionId() << 32 | closed
            ids = np.frombuffer(b"".join(parts), "<u4").astype("<u2")
            who = pa.chunked_array(names).combine_chunks()
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(who)], pa.int32()), who),
                 pa.array([ids.tobytes()], pa.binary()), pa.array([np.cumsum(sizes).astype("<i8").tobytes()], pa.binary())],
                ["block", "doc_ids", "ids", "ends"],
            )

        for batch in batches:
            who = batch.column("doc_id")
            for i, text in enumerate(batch.column("text")):
                ids = own.encode(text.as_py())
                names.append(who.slice(i, 1))
                parts.append(ids)
                sizes.append(len(ids) // 4)
                held += sizes[-1]
                if held >= block_tokens or len(sizes) >= block_tokens:
                    yield close()
                    closed, held, names, parts, sizes = closed + 1, 0, [], [], []
        if names:
            yield close()
        own._kept.trim()

    return materialize(rows.mapInArrow(encode, f"block long, doc_ids array<{kind}>, ids binary, ends binary"), "blocks")


def _tokens(ids: bytes, ends: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Token ids, and the number of the document of each."""
    stops = np.frombuffer(ends, "<i8")
    owner = np.repeat(np.arange(len(stops), dtype=np.int32), np.diff(stops, prepend=0))
    return np.frombuffer(ids, "<u2"), owner


def _pairs(tokens: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs inside documents, and where the second token of each stands."""
    at = np.flatnonzero(owner[1:] == owner[:-1]) + 1
    return tokens[at - 1].astype(np.uint32) << np.uint32(16) | tokens[at], at


def _slices(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive documents with about so many tokens together, one document at least."""
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield start, stop
        start = stop


def _parted(pairs: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs with their counts, ordered by hash part, and the parts' bounds."""
    unique, counts = np.unique(pairs, return_counts=True)
    part = (mix(unique.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return unique[order], counts[order], np.searchsorted(part[order], np.arange(parts + 1))


def _singles(stored: DataFrame) -> np.ndarray:
    """Counts of all tokens; the result has one row for each vocabulary entry at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # all texts are encoded: the words that this worker has kept can go
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                total += np.bincount(np.frombuffer(ids.as_py(), "<u2"), minlength=1 << 16)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["token", "n"])

    table = np.zeros(1 << 16, np.int64)
    for row in stored.select("ids").mapInArrow(count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
        table[row["token"]] = row["n"]
    return table


def pair_totals(stored: DataFrame, parts: int) -> DataFrame:
    """(block, part, totals): for every block the corpus counts of its pairs, in their order."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for i in range(batch.num_rows):
                pairs, _ = _pairs(*_tokens(batch.column("ids")[i].as_py(), batch.column("ends")[i].as_py()))
                unique, counts, bounds = _parted(pairs, parts)
                cut = lambda x: [x[a:b].astype("<u4").tobytes() for a, b in zip(bounds, bounds[1:])]  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("block")[i].as_py()] * parts, pa.int64()), pa.array(np.arange(parts, dtype=np.int32)),
                     pa.array(cut(unique), pa.binary()), pa.array(cut(counts), pa.binary())],
                    ["block", "part", "pairs", "counts"],
                )

    def join(key: tuple, table: pa.Table) -> pa.Table:
        held = [np.frombuffer(x, "<u4") for x in table.column("pairs").to_pylist()]
        unique, at = np.unique(np.concatenate(held), return_inverse=True)
        counts = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()])
        totals = np.zeros(len(unique), np.int64)
        np.add.at(totals, at, counts)
        back, ends = totals[at].astype("<i8"), np.cumsum([len(h) for h in held])
        small = totals.max(initial=0) < 1 << 32
        packed = [x.astype("<u4" if small else "<i8").tobytes() for x in np.split(back, ends[:-1])]
        return pa.table({
            "block": table.column("block"), "part": table.column("part"),
            "totals": pa.array(packed, pa.binary()), "wide": pa.array([not small] * len(held)),
        })

    dealt = stored.select("block", "ids", "ends").mapInArrow(explode, "block long, part int, pairs binary, counts binary")
    return dealt.groupBy("part").applyInArrow(join, "block long, part int, totals binary, wide boolean")


def scores(documents: DataFrame, path: str, backoff: float = BACKOFF, block_tokens: int = BLOCK_TOKENS, part_pairs: int = PART_PAIRS) -> DataFrame:
    """(doc_id, n_tokens, log_score, mean_log_score) of every document; logarithms are natural."""
    stored = blocks(documents, path, block_tokens)
    kind = documents.schema["doc_id"].dataType.simpleString()
    singles = _singles(stored)
    parts = max(1, int(-(-singles.sum() // part_pairs)))
    shared = documents.sparkSession.sparkContext.broadcast(singles)

    def own(values: np.ndarray, where: np.ndarray) -> np.ndarray:
        """How often each value occurs in its own document."""
        code = where.astype(np.uint64) << np.uint64(32) | values.astype(np.uint64)
        _, back, counts = np.unique(code, return_inverse=True, return_counts=True)
        return counts[back]

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        forget()
        who, n_tokens, sums = [], [], []
        singles = shared.value
        total = singles.sum()
        for row in range(left.num_rows):
            ids, ends = (left.column(c)[row].as_py() for c in ("ids", "ends"))
            tokens, owner = _tokens(ids, ends)
            stops = np.frombuffer(ends, "<i8")
            size = np.diff(stops, prepend=0)
            unique = _parted(_pairs(tokens, owner)[0], parts)[0]
            got = sorted(zip(right.column("part").to_pylist(), right.column("totals").to_pylist(), right.column("wide").to_pylist(), strict=True))
            totals = np.concatenate([np.frombuffer(t, "<i8" if wide else "<u4").astype(np.int64) for _, t, wide in got])
            by = np.argsort(unique)
            unique, totals = unique[by], totals[by]
            value_of = np.zeros(len(size))
            for a, b in _slices(stops, SLICE_TOKENS):
                begin, end = (stops[a - 1] if a else 0), stops[b - 1]
                here, doc = tokens[begin:end], owner[begin:end] - a
                pairs, at = _pairs(here, doc)
                rest = np.maximum(total - size[a:b], 1)[doc]
                mine = singles[here] - own(here, doc)  # in all other documents
                single = np.log(np.where(mine > 0, mine, 1) / rest)
                single = np.where(mine > 0, single, np.log(backoff) - np.log(rest))
                value = single.copy()
                seen = totals[np.searchsorted(unique, pairs)] - own(pairs, doc[at]) if len(pairs) else np.zeros(0)
                logs = np.log(np.maximum(seen, 1)) - np.log(np.maximum(mine[at - 1], 1))
                value[at] = np.where(seen > 0, logs, np.where(mine[at] > 0, np.log(backoff), 0.0) + single[at])
                value_of[a:b] = np.bincount(doc, weights=value, minlength=b - a)
            who.append(left.column("doc_ids")[row].values)
            n_tokens.append(size)
            sums.append(value_of)
        if not who:
            return pa.table({"doc_id": pa.array([], left.schema.field("doc_ids").type.value_type), "n_tokens": pa.array([], pa.int64()), "log_score": pa.array([], pa.float64())})
        return pa.table({
            "doc_id": pa.chunked_array(who), "n_tokens": np.concatenate(n_tokens), "log_score": np.concatenate(sums),
        })

    scored = stored.groupBy("block").cogroup(pair_totals(stored, parts).groupBy("block")).applyInArrow(
        score, f"doc_id {kind}, n_tokens long, log_score double"
    )
    return scored.withColumn("mean_log_score", F.round(F.col("log_score") / F.nullif("n_tokens", F.lit(0)), 6)).withColumn(
        "log_score", F.round("log_score", 6)
    )
