"""Document fingerprints by locally consistent parsing.

A text's code points are parsed into phrases, these into longer phrases, until one is left. Runs of
an equal symbol are folded first, so neighbours differ. Then deterministic coin tossing gives small
labels: a symbol's label is the lowest bit in which it differs from its left neighbour, with that
bit's value; repeated on the labels, six values remain, and neighbours still differ. A phrase starts at
every local maximum, so it holds two symbols or more but for a text's first one, and about a dozen at
most. Its name is a hash of its symbols. What a position is called depends on a few symbols around it
only, so equal substrings share all names inside, wherever they lie; only names near their ends
depend on what is outside.

The features of a text are the names from ``FROM_LEVEL`` up, and the name of the whole text; the second
occurrence of a name is another feature, so a text of one repeated line weighs its copies. A
fingerprint is the whole text's name, 16 hex digits, and a sketch of 64 bins: a feature falls
into the bin of its hash, and a bin keeps the smallest 16 bits, four hex digits, zero where it is empty.
The likeness of two fingerprints is 1 for equal names, else the share of bins that agree among
those that either fills: an estimate of the features' Jaccard similarity,
with a standard error of at most a sixteenth.

Documents are dealt out by ranges of their id and sorted, so a document's successor is the next row;
each text is moved once. The first row of each range is handed to the last of the range before,
and the very first to the very last. Rows with equal ids follow by their texts' hashes, null ids come
first; a null text is empty, and two empty texts are alike. A table of one row is its own successor; an
empty table has no rows. A text of any length is parsed whole, in memory of about 60 bytes a code
point at a time; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tillcast.llm.common import mix, salted, span_hashes
from tillcast.session import materialize

#: The first level whose names are features: phrases of phrases, ten code points and more.
FROM_LEVEL = 2
BINS = 64
#: Code points that a task parses at once; a longer text is parsed alone.
CHUNK = 100_000
#: Rows of a range, and ranges of a table at most.
RANGE_ROWS = 10_000
MAX_RANGES = 20_000


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _previous(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Every symbol's left neighbour; a text's first symbol gets one that differs in its lowest bit."""
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[starts] = ~x[starts]
    return before


def _folded(x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of an equal symbol as one symbol, with the new bounds of the texts."""
    edge = x != _previous(x, bounds[:-1])
    at = np.flatnonzero(edge)
    if len(at) == len(x):
        return x, bounds
    length = np.diff(at, append=len(x))
    out = x[at]
    long_ = length > 1
    out[long_] = mix(out[long_] + mix(length[long_].astype(np.uint64)))
    return out, np.searchsorted(at, bounds)


def _labels(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Labels of 0 to 5 by coin tossing; neighbours within a text differ."""
    different = x ^ _previous(x, starts)
    lowest = np.bitwise_count((different & (~different + np.uint64(1))) - np.uint64(1))
    x = (lowest << 1 | (x >> lowest.astype(np.uint64) & np.uint64(1)).astype(np.uint8)).astype(np.uint8)
    for _ in range(3):  # 128 labels, 14, 8, 6
        different = x ^ _previous(x, starts)
        lowest = np.bitwise_count((different & (~different + np.uint8(1))) - np.uint8(1))
        x = lowest << 1 | (x >> lowest & np.uint8(1))
    return x


def parse(x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: the names of the phrases of some texts that are not empty, and their bounds."""
    x, bounds = _folded(x, bounds)
    starts = bounds[:-1]
    label = _labels(x, starts).astype(np.int8)
    left, right = np.empty_like(label), np.empty_like(label)
    left[1:], right[:-1] = label[:-1], label[1:]
    right[bounds[1:] - 1] = 127  # a text's last symbol starts no phrase
    opens = (label > left) & (label > right)
    opens[starts] = True
    at = np.flatnonzero(opens)
    return span_hashes(x, at, np.append(at[1:], len(x))), np.searchsorted(at, bounds)


def _occurrences(names: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How often each name stood in its text before, in order of place."""
    order = np.lexsort((names, owner))
    new = np.ones(len(order), bool)
    new[1:] = (names[order][1:] != names[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    first = np.flatnonzero(new)
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
    return out


def _sketch(names: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
    """Put names, told apart by occurrence, into their texts' bins; the smallest of a bin stays."""
    h = salted(names + mix(_occurrences(names, owner).astype(np.uint64)), 13)
    bins = (h >> np.uint64(58)).astype(np.int64)
    value = np.clip(h & np.uint64(0xFFFF), 1, 0xFFFE).astype(np.uint16)
    np.minimum.at(out.reshape(-1), owner * BINS + bins, value)


def fingerprints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(names of the whole texts, sketches): uint64 and uint16 by 64; an empty text has zeros."""
    roots = np.zeros(len(texts), np.uint64)
    bins = np.full((len(texts), BINS), 0xFFFF, np.uint16)
    points = [code_points(t) for t in texts]
    open_ = np.flatnonzero([len(p) > 0 for p in points])
    if len(open_):
        x = np.concatenate([points[i] for i in open_]).astype(np.uint64) + np.uint64(1)
        bounds = np.concatenate([[0], np.cumsum([len(points[i]) for i in open_])])
        level = 0
        while len(open_):
            x, bounds = parse(x, bounds)
            level += 1
            sizes = np.diff(bounds)
            done = sizes == 1
            if level >= FROM_LEVEL:
                _sketch(x, np.repeat(open_, sizes), bins)
            elif done.any():
                _sketch(x[bounds[:-1][done]], open_[done], bins)
            roots[open_[done]] = x[bounds[:-1][done]]
            if done.any():
                x, open_ = x[np.repeat(~done, sizes)], open_[~done]
                bounds = np.concatenate([[0], np.cumsum(sizes[~done])])
    bins[bins == 0xFFFF] = 0
    return roots, bins


def packed(roots: np.ndarray, bins: np.ndarray) -> list[bytes]:
    """Fingerprints as bytes: the name of the whole text, then the bins."""
    return [r.tobytes() + b.tobytes() for r, b in zip(roots.astype(">u8"), bins.astype(">u2"), strict=True)]


def written(roots: np.ndarray, bins: np.ndarray) -> list[str]:
    """Fingerprints as hex."""
    return [f.hex() for f in packed(roots, bins)]


def likenesses(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Likeness of fingerprints, row by row."""
    filled = (a[1] != 0) | (b[1] != 0)
    agree = ((a[1] == b[1]) & filled).sum(axis=1)
    share = agree / np.maximum(filled.sum(axis=1), 1)
    return np.where(a[0] == b[0], 1.0, share)


def likeness(a: str, b: str) -> float:
    """Likeness of two written fingerprints."""
    read = lambda f: (np.array([int(f[:16], 16)], np.uint64), np.frombuffer(bytes.fromhex(f[16:]), ">u2")[None].astype(np.uint16))
    return float(likenesses(read(a), read(b))[0])


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the start of the following one."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


#: Digests and fingerprints are bytes until the end, half as long as their hex.
_OUT = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()),
    ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def _compared(ids: list[int | None], texts: list[str], own: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """Rows of all texts but the last, each with its successor in the list."""
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    first, after = tuple(x[:-1] for x in own), tuple(x[1:] for x in own)
    other = fingerprints(changed)
    columns = [
        ids[: len(changed)], [len(t) for t in texts[:-1]],
        [hashlib.sha256(t.encode("utf-8", "replace")).digest() for t in changed], packed(*first), packed(*other),
        likenesses(first, other), likenesses(first, after),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def _joined(a, b):
    return tuple(np.concatenate(x) for x in zip(a, b, strict=True))


def successors(batches: Iterator[tuple[list, list]]) -> Iterator[tuple]:
    """Compare the rows of a sorted stream with their successors, a chunk of texts at a time.

    Yields ("rows", batch), and at the end ("ends", first text, last id, last text).
    """
    first = None
    ids, texts, own = [], [], (np.zeros(0, np.uint64), np.zeros((0, BINS), np.uint16))
    for more_ids, more in batches:
        at = 0
        while at < len(more):
            size, to = 0, at
            while to < len(more) and (to == at or size + len(more[to]) <= CHUNK):
                size, to = size + len(more[to]), to + 1
            first = more[0] if first is None else first
            ids, texts, own = ids + more_ids[at:to], texts + more[at:to], _joined(own, fingerprints(more[at:to]))
            if len(texts) > 1:
                yield "rows", _compared(ids, texts, own)
            ids, texts, own = ids[-1:], texts[-1:], tuple(x[-1:] for x in own)
            at = to
    if texts:
        yield "ends", first, ids[0], texts[0]


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of all texts and their edits, and their likeness to those and to the next text's."""
    total = docs.select(key).count()
    ranges = max(1, min(MAX_RANGES, -(-total // range_rows)))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(ranges, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text", F.spark_partition_id().alias("part"))
    ends = [("part", pa.int32()), ("head", pa.string()), ("tail_id", pa.int64()), ("tail", pa.string())]
    schema = pa.schema([*_SCHEMA, *ends])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = []

        def read():
            for batch in batches:
                if batch.num_rows:
                    part[:] = [batch.column("part")[0].as_py()]
                    yield batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()

        for kind, *found in successors(read()):
            if kind == "rows":
                blank = [pa.nulls(found[0].num_rows, t) for _, t in ends]
                yield pa.RecordBatch.from_arrays([*found[0].columns, *blank], schema=schema)
            else:
                head, tail_id, tail = found
                own = [part[0], head, tail_id, tail]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in _SCHEMA), *(pa.array([v], t) for v, (_, t) in zip(own, ends))], schema=schema)

    done = materialize(dealt.mapInArrow(run, f"{_OUT}, part int, head string, tail_id long, tail string"), "fingerprints")
    # one row a range, MAX_RANGES at most: their numbers are put in order, the texts follow by a join
    order = W.orderBy("part")
    after = F.coalesce(F.lead("part").over(order), F.first("part").over(order)).alias("after")
    links = done.where("part is not null").select("part", after)
    tails = done.where("part is not null").select("part", "tail_id", "tail").join(links, "part")
    heads = done.where("part is not null").select(F.col("part").alias("after"), "head")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, tail, head in zip(*(batch.column(c).to_pylist() for c in ("tail_id", "tail", "head")), strict=True):
                yield _compared([doc], [tail, head], fingerprints([tail, head]))

    closing = tails.join(heads, "after").select("tail_id", "tail", "head").mapInArrow(last, _OUT)
    found = done.where("part is null").select(*_SCHEMA.names).unionByName(closing)
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})
