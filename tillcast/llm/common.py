"""Helpers of several operators: word hashes, chunk splitting, components, block folding."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillcast.session import materialize

#: Bytes of text that a task turns into arrays at once, and rows of a batch that it takes out together.
CHUNK_BYTES = 1 << 19
ROWS_AT_ONCE = 1000
#: Bytes of words that are hashed at once: eight-fold arrays of them and the powers are held beside the text.
BLOCK_BYTES = 1 << 18

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_BLANKS = bytes.maketrans(b"\t\n\r\x0b\x0c", b"     ")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


_KEPT: list = []


def kept(build: Callable) -> Callable:
    """Keep what ``build`` returns in each worker, also between tasks, until ``forget``."""
    _KEPT.append(cache(build))
    return _KEPT[-1]


def forget() -> None:
    """Let go what earlier stages have left in this worker, before a stage that has no use for it."""
    for held in _KEPT:
        held.cache_clear()
    _POWERS.clear()
    give_back()


def give_back() -> None:
    """Return to the system what this worker has freed: its allocators keep it for themselves otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the usual C library on Linux has it
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers; a bijection, so different inputs stay different."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    return mix(x + np.uint64(int(_ODD) * (salt + 1) & (1 << 64) - 1))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to ``n`` at least of an odd number and of its inverse, modulo 2 ** 64; the longest so far are kept."""
    if not _POWERS or len(_POWERS[0][0]) <= n:
        size = max(1 << 16, 1 << max(n - 1, 0).bit_length())
        out = []
        for base in (int(_ODD), pow(int(_ODD), -1, 1 << 64)):
            x = np.full(size + 1, base, np.uint64)
            x[0] = 1
            out.append(np.cumprod(x, out=x))
        _POWERS[:] = [tuple(out)]
    return _POWERS[0]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ``values[start:end]``, by differences of one running sum."""
    power, back = powers(len(values))
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * power[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * back[starts])


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, and the bounds of each text's words.

    Words are separated by ASCII white space; case and ASCII punctuation do not count, and
    what is punctuation only is no word. Null texts have no words.
    """
    parts = [
        (t or "").lower().encode("utf-8", "replace").translate(_BLANKS, _PUNCTUATION) for t in texts
    ]
    sizes = np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts))
    raw = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)
    inside = raw != 32
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends_of_text = np.cumsum(sizes)
    bounds = np.concatenate([[0], np.searchsorted(starts, ends_of_text)])
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    out, word = np.empty(len(starts), np.uint64), 0
    while word < len(starts):  # blocks of words, so that the sums stay small beside a very long text
        after = max(word + 1, int(np.searchsorted(ends, starts[word] + BLOCK_BYTES, side="right")))
        a, b = starts[word], ends[after - 1]
        values = raw[a:b].astype(np.uint64) + np.uint64(1)
        out[word:after] = span_hashes(values, starts[word:after] - a, ends[word:after] - a)
        word = after
    return mix(out + (ends - starts).astype(np.uint64) * _ODD), bounds


def word_spans(text: str) -> list[tuple[int, int]]:
    """Character spans of the words that ``word_hashes`` sees, in order."""
    import re

    marks = set(_PUNCTUATION.decode())
    return [
        m.span() for m in re.finditer(r"[^ \t\n\r\x0b\x0c]+", text) if not marks.issuperset(m[0])
    ]


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int, short: bool = False):
    """Hashes of all runs of ``width`` words inside each text, and their bounds.

    With ``short`` a text of fewer words, but at least one, has one shingle of all its words.
    """
    counts = np.diff(bounds)
    n = np.maximum(counts - width + 1, 0)
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + bounds[:-1][owner]
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        out = mix(out * _ODD + hashes[at + k]) if k else hashes[at].copy()
    if short and (few := (counts > 0) & (counts < width)).any():
        extra = []
        for t in np.flatnonzero(few):
            h = np.array([counts[t]], np.uint64)
            for w in hashes[bounds[t] : bounds[t + 1]]:
                h = mix(h * _ODD + w)
            extra.append(h[0])
        owner = np.concatenate([owner, np.flatnonzero(few)])
        order = np.argsort(owner, kind="stable")
        out, n = np.concatenate([out, np.array(extra, np.uint64)])[order], n + few
    return out, np.concatenate([[0], np.cumsum(n)])


def chunks(texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive texts of about ``limit`` characters together, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text or "") > limit:
            yield start, i
            start, size = i, 0
        size += len(text or "") + 1
    if start < len(texts):
        yield start, len(texts)


def text_chunks(column: pa.Array) -> Iterator[tuple[int, int, list[str | None]]]:
    """``chunks`` of a text column with their texts, of which few are taken out of the column at a time."""
    for start in range(0, len(column), ROWS_AT_ONCE):
        some = column.slice(start, ROWS_AT_ONCE).to_pylist()
        for a, b in chunks(some):
            yield start + a, start + b, some[a:b]


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def release(spark: SparkSession) -> None:
    """Let the shuffle files of finished stages go before the next large stage.

    Spark deletes them when the driver's garbage collector finds their plans unused, which may
    otherwise be long after; what is still read stays.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def wrapped(rows: DataFrame, **columns: Column) -> DataFrame:
    """(row, ...): all columns of ``rows`` in one struct, so that no name of theirs can clash."""
    return rows.select(
        F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), *(c.alias(n) for n, c in columns.items())
    )


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that links reach, for every node with a link.

    Every node takes the smallest label among its neighbours, then its label's label; both
    are joins and aggregates that combine before the shuffle, and each round is stored. The
    number of rounds follows the logarithm of the longest chain, not the size of a component.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    links = materialize(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = materialize(
        links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("c")).select(F.col("u").alias("node"), "c"),
        "labels",
    )
    while True:
        near = links.join(labels.select(F.col("node").alias("v"), "c"), "v").groupBy(F.col("u").alias("node")).agg(F.min("c").alias("m"))
        taken = labels.join(near, "node").select("node", "c", F.least("c", "m").alias("m"))
        # nodes that hold a label tell each other: the label's own label is at least as small
        hooks = taken.groupBy(F.col("c").alias("node")).agg(F.min("m").alias("h"))
        taken = taken.join(hooks, "node", "left").select("node", "c", F.least("m", "h").alias("m"))
        jump = taken.select(F.col("node").alias("m"), F.col("m").alias("up"))
        after = materialize(
            taken.join(jump, "m", "left").select("node", F.least("m", "up").alias("c"), (F.least("m", "up") != F.col("c")).alias("moved")),
            "labels",
        )
        labels = after.select("node", "c")
        if after.where("moved").limit(1).count() == 0:
            return labels.select("node", F.col("c").alias("component"))
