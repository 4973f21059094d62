import hashlib
import random

import numpy as np
import pytest

from tillcast.llm import phrases
from tillcast.llm.common import mix, span_hashes

SCHEMA = "doc_id long, text string"


def scalar(f, *values):
    return int(f(*(np.array([v], np.uint64) for v in values))[0])


def name(symbols):
    return int(span_hashes(np.array(symbols, np.uint64), np.array([0]), np.array([len(symbols)]))[0])


def toss(symbols, width):
    """Label of each symbol against its left neighbour; the first one's neighbour differs in bit 0."""
    out = []
    for i, x in enumerate(symbols):
        d = x ^ symbols[i - 1] if i else 1
        k = (d & -d).bit_length() - 1
        out.append(2 * k + (x >> k & 1))
    return out


def levels(text):
    """All levels' names of one text, symbol by symbol."""
    symbols = [ord(c) + 1 for c in text]
    out = []
    while symbols and (not out or len(out[-1]) > 1):
        runs = []
        for x in symbols:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        symbols = [x if n == 1 else scalar(mix, (x + scalar(mix, n)) % 2**64) for x, n in runs]
        label = symbols
        for _ in range(4):
            label = toss(label, 64)
        assert all(0 <= v < 6 for v in label) and all(a != b for a, b in zip(label, label[1:]))
        starts = [0] + [i for i in range(1, len(label) - 1) if label[i - 1] < label[i] > label[i + 1]]
        phrases_ = [symbols[a:b] for a, b in zip(starts, [*starts[1:], len(symbols)])]
        assert all(len(p) > 1 for p in phrases_[1:])
        symbols = [name(p) for p in phrases_]
        out.append(symbols)
    return out


def features(text):
    parsed = levels(text)
    names = [n for level in parsed[phrases.FROM_LEVEL - 1 :] for n in level] or (parsed[-1] if parsed else [])
    seen, out = {}, set()
    for level in parsed[phrases.FROM_LEVEL - 1 :] if names else []:
        seen = {}
        for n in level:
            seen[n] = seen.get(n, -1) + 1
            out.add((n, seen[n]))
    return out or {(n, 0) for n in names}


def texts(seed):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdeé👩 ", k=draw.randint(1, 9))) for _ in range(300)]
    return ["", "a", "aa", "aaaaaaaa", "ab" * 40, "\x00\x00a", "x" * 3000 + "y", *(" ".join(draw.choices(words, k=draw.randint(1, 300))) for _ in range(40))]


def test_parsing_against_single_symbols():
    held = texts(1)
    roots, bins = phrases.fingerprints(held)
    for text, root, row in zip(held, roots, bins):
        parsed = levels(text)
        assert int(root) == (parsed[-1][0] if parsed else 0)
        want = np.full((1, phrases.BINS), 0xFFFF, np.uint16)
        for n, k in features(text):
            h = np.array([n], np.uint64) + mix(np.array([k], np.uint64))
            phrases._sketch(h - mix(np.zeros(1, np.uint64)), np.zeros(1, np.int64), want)
        assert (np.where(want == 0xFFFF, 0, want)[0] == row).all()
    assert len(set(phrases.written(roots, bins))) == len(held)


def test_equal_substrings_share_their_interior():
    draw = random.Random(3)
    inner = "".join(draw.choices("abcdefgh ", k=3000))
    a = levels("".join(draw.choices("abcdefgh ", k=517)) + inner)
    b = levels(inner + "".join(draw.choices("xyz", k=100)))
    for level in range(4):
        shared = set(a[level]) & set(b[level])
        whole = set(levels(inner)[level])
        assert len(whole - shared) <= 12  # names near the two ends only


def jaccard(a, b):
    x, y = features(a), features(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def expected(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, _tie(r[1] or ""))
    rows = sorted(rows, key=key)
    out = []
    for (doc, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        quarter = len(text) // 4
        other = text[: len(text) - quarter] + after[:quarter]
        fingerprint, changed, following = (phrases.written(*phrases.fingerprints([t]))[0] for t in (text, other, after))
        out.append((doc, len(text), hashlib.sha256(other.encode()).hexdigest(), fingerprint, changed, phrases.likeness(fingerprint, changed), phrases.likeness(fingerprint, following)))
        assert abs(phrases.likeness(fingerprint, changed) - jaccard(text, other)) < 0.3
    return sorted(out, key=str)


_TIES = {}


def _tie(text):
    return _TIES[text]


@pytest.mark.parametrize("range_rows", [10_000, 7])
def test_whole_query(spark, range_rows):
    rows = [(i, t) for i, t in enumerate(texts(9))] + [(4, "tie one"), (4, "tie two"), (5, None), (5, None), (None, "no id"), (900, "long " * 60_000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    _TIES.update({r.t: r.h for r in frame.selectExpr("coalesce(text, '') t", "xxhash64(coalesce(text, '')) h").collect()})
    found = phrases.neighbours(frame.selectExpr("*", "1 as part", "'x' as fingerprint", "2 as n_chars"), range_rows=range_rows)
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected(rows)


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(3, "abcdefgh")], SCHEMA)
    row = phrases.neighbours(one).collect()
    assert [(r.doc_id, r.n_chars, r.edited_sha256, r.near_next) for r in row] == [(3, 8, hashlib.sha256(b"abcdefab").hexdigest(), 1.0)]
    assert phrases.neighbours(one.limit(0)).count() == 0
