import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tillcast.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if (v := row[c]) is None else f"{len(str(v).encode())}:{v}" for c in COLUMNS))


def tree(nodes, fan=3):
    """(root, path of each node): the path has the run and the own place in it, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, range(len(paths))):
            run = nodes[at[i] // fan * fan : at[i] // fan * fan + fan]
            path.append((run, at[i] % fan))
        nodes = [h(*nodes[k : k + fan]) for k in range(0, len(nodes), fan)]
        at = [a // fan for a in at]
    return nodes[0], paths


def expected(rows, fan=3):
    groups = {}
    for row in rows:
        groups.setdefault(row["source"], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in groups[s]], fan)
    if not order:
        return []
    root, tops = tree([trees[s][0] for s in order], fan)
    out = []
    for s, top in zip(order, tops):
        for row, path in zip(groups[s], trees[s][1]):
            whole = path + top
            proof = h(*(n for run, k in whole for j, n in enumerate(run) if j != k))
            told = row
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0 and row["text"] is not None:
                told = row | {"text": row["text"].replace("\n", "")}
            node = leaf(told)
            for run, k in whole:
                node = h(*run[:k], node, *run[k + 1 :])
            out.append((row["doc_id"], leaf(row), trees[s][0], root, proof, node, node == root))
    return out


def rows_of(n, seed):
    draw = random.Random(seed)
    sources = [None, "", "a", "é", "z", "\U0001f600"]
    out = []
    for i in range(n):
        out.append({
            "doc_id": draw.choice([i, i, i, i // 2, None]), "text": draw.choice([None, "", "a\nb", f"t{i}\n", f"x{i}", "-", "é" * 3]),
            "lang": draw.choice([None, "en", ""]), "source": "hot" if draw.random() < 0.4 else draw.choice(sources), "n_chars": draw.choice([None, 0, i]),
        })
    return out + out[: n // 5] + ([{"doc_id": 10**6, "text": "long\n" * 100_000, "lang": "en", "source": "one", "n_chars": 500_000}] if n > 5 else [])


def got(spark, rows, **sizes):
    frame = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)
    # names that the operator uses itself
    return merkle.verified(frame.selectExpr("*", "1 as tree", "2 as place", "3 as digest", "4 as root", "5 as witness"))


@pytest.mark.parametrize("n", [0, 2, 120])
def test_against_plain_trees(spark, n):
    rows = rows_of(n, n)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got(spark, rows).collect()), key=key) == sorted(expected(rows), key=key)


@pytest.mark.parametrize("fan, levels", [(3, 1), (2, 2)])
def test_blocks_of_any_size_give_the_same_tree(spark, fan, levels):
    rows = rows_of(90, 3)
    frame = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)
    found = merkle.manifest(frame, COLUMNS, "source", "doc_id", fan, levels)
    siblings = F.array_join(F.transform("witness", lambda s: F.lower(F.hex(F.concat(s["left"], s["right"])))), "")
    found = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof"), merkle.fold(F.unhex("leaf"), F.col("witness")).alias("folded"))
    key = lambda r: tuple(map(str, r))
    want = sorted((r[:5] for r in expected(rows, fan)), key=key)
    rows = sorted((tuple(r) for r in found.collect()), key=key)
    assert [r[:5] for r in rows] == want and all(r[5] == r[3] for r in rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 80])
def test_witnesses_while_appending(n):
    digests = [bytes([i]) * 32 for i in range(n)]
    subtrees = merkle.Appender()
    nodes = [subtrees.append(d) for d in digests]
    root, paths = tree([d.hex() for d in digests])
    top = subtrees.close()
    assert top.digest.hex() == root
    for node, path in zip(nodes, paths):
        for run, k in path:
            assert (node.left.hex(), node.right.hex()) == ("".join(run[:k]), "".join(run[k + 1 :]))
            node = node.parent
        assert node is top
