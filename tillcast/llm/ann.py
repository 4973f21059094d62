"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample (``SAMPLE_ROWS`` vectors, those with the smallest hash
of their id; ``LEAF_ROWS`` rows a leaf are aimed at, with at most a quarter of the sample as
leaves). Every vector is then put into a leaf by going down the tree. A query takes the leaves in the
order of a priority queue: the nearest child is followed to its leaf, the others wait with
their distance. How many leaves it visits is calibrated: the true neighbours of
``CALIBRATION_ROWS`` vectors are computed over all rows, and the visits widen until the leaves
of ``target`` of them are reached. Distances are then computed from the original vectors in
double precision.

Equal vectors are one entry with their smallest ids, k + 1 at most: no later one can be among k
neighbours. A query meets its leaves by ``SUBTREES`` runs of neighbouring leaves: one row for each
run, with the list of its leaves there, so that its rows do not grow with the table. The nearest
``FIRST_LEAVES`` leaves come first; the others then give only what can still come before the k-th
neighbour found there. Rows and queries of a run meet in groups of bounded size, so a run
that many share is split. The tree, the sample and the number of leaves are
bounded whatever the table's size, and only they are sent to the tasks.

Vectors that are null, empty, zero, hold nulls or non-finite numbers, differ from the usual
length, or have a null id take no part. Rows that repeat an id with the same vector count
once; rows with the query's id are its own. Ties go to the smaller id. A query without
candidates gives no rows; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tillcast.session import materialize

SAMPLE_ROWS = 20_000
LEAF_ROWS = 128
BRANCHES = 8
CALIBRATION_ROWS = 128
#: Rows and queries of a group in which distances are computed, and runs of leaves.
GROUP_ROWS = 8192
SUBTREES = 16
#: Leaves whose k-th distance bounds what the later ones give.
FIRST_LEAVES = 4


@dataclass
class Tree:
    """Nodes in arrays: children and their centres; a node without children is a leaf."""

    children: list[np.ndarray]
    centres: list[np.ndarray]

    @property
    def leaves(self) -> int:
        return sum(len(c) == 0 for c in self.children)

    def runs(self, n: int) -> np.ndarray:
        """The run, of ``n`` with about as many leaves each, that every leaf lies in; neighbours share one."""
        order, stack = [], [0]
        while stack:
            node = stack.pop()
            below = self.children[node]
            if len(below):
                stack.extend(below.tolist()[::-1])
            else:
                order.append(node)
        out = np.full(len(self.children), -1, np.int64)
        out[order] = np.arange(len(order)) * n // len(order)
        return out

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf that each vector falls into."""
        at = np.zeros(len(vectors), np.int64)
        going = np.arange(len(vectors))
        while len(going):
            nodes = at[going]
            for node in np.unique(nodes):
                kids = self.children[node]
                if len(kids):
                    rows = going[nodes == node]
                    at[rows] = kids[_nearest(vectors[rows], self.centres[node])]
            going = going[[len(self.children[n]) > 0 for n in at[going]]]
        return at

    def visit(self, query: np.ndarray, most: int) -> list[int]:
        """Leaves for a query, best bin first."""
        queue, found = [(0.0, 0)], []
        while queue and len(found) < most:
            _, node = heapq.heappop(queue)
            while len(kids := self.children[node]):
                far = ((self.centres[node] - query) ** 2).sum(1)
                best = int(far.argmin())
                for k, d in enumerate(far.tolist()):
                    if k != best:
                        heapq.heappush(queue, (d, int(kids[k])))
                node = int(kids[best])
            found.append(node)
        return found


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * rows @ centres.T).argmin(1)


def fit(sample: np.ndarray, leaves: int, branches: int = BRANCHES, rounds: int = 8, seed: int = 0) -> Tree:
    """Split the sample by k-means, and each part again, until there are about ``leaves`` parts."""
    random = np.random.default_rng(seed)
    tree = Tree([], [])

    def grow(rows: np.ndarray, quota: int) -> int:
        node = len(tree.children)
        tree.children.append(np.zeros(0, np.int64))
        tree.centres.append(np.zeros((0, sample.shape[1])))
        k = min(branches, quota, len(rows))
        if k < 2:
            return node
        points = sample[rows]
        centres = points[random.choice(len(points), k, replace=False)]
        for _ in range(rounds):
            own = _nearest(points, centres)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, points)
            counts = np.bincount(own, minlength=k)
            centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        own = _nearest(points, centres)
        used = np.unique(own)
        if len(used) < 2:
            return node
        kids = [grow(rows[own == c], round(quota * (own == c).mean())) for c in used]
        tree.children[node], tree.centres[node] = np.array(kids), centres[used]
        return node

    if len(sample):
        grow(np.arange(len(sample)), leaves)
    else:
        tree.children.append(np.zeros(0, np.int64))
        tree.centres.append(np.zeros((0, 0)))
    return tree


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def usable(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): the vectors that take part, as doubles, each row once."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    infinite = F.lit(float("inf"))
    rows = rows.where("vec_id is not null and v is not null and size(v) > 0").where(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)) & F.exists("v", lambda x: x != 0)
    )
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (usual["n"] if usual else 0)).distinct()


def entries(vectors: DataFrame, k: int) -> DataFrame:
    """(v, ids): different vectors with their k + 1 smallest ids."""
    first = Window.partitionBy("v").orderBy("vec_id")
    kept = vectors.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    return kept.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def closest(query_id: int, query: np.ndarray, vectors: np.ndarray, ids: np.ndarray, owner: np.ndarray, k: int):
    """(ids, scores) of the k nearest candidates; ``owner`` gives the vector of each id."""
    diff = vectors - query
    d = np.sqrt((diff * diff).sum(1))[owner]
    other = np.flatnonzero(ids != query_id)
    if len(other) > k:
        limit = np.partition(d[other], k - 1)[k - 1]
        other = other[d[other] <= limit]
    best = other[np.lexsort((ids[other], d[other]))][:k]
    return ids[best], d[best]


def exact(queries: list[tuple[int, list[float]]], index: DataFrame, k: int) -> DataFrame:
    """True neighbours (query_id, rank, vec_id, score, leaf) of a bounded set of queries."""
    ids, vectors = [q[0] for q in queries], np.array([q[1] for q in queries], np.float64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, members = _matrix(batch.column("v")), batch.column("ids")
            owner = np.repeat(np.arange(len(v)), np.diff(members.offsets.to_numpy()))
            flat, leaf = members.flatten().to_numpy(), batch.column("leaf").to_numpy()
            by_id = np.argsort(flat, kind="stable")
            out = []
            for q, x in zip(ids, vectors, strict=True):
                near, score = closest(q, x, v, flat, owner, k)
                at = leaf[owner[by_id[np.searchsorted(flat, near, sorter=by_id)]]]
                out += zip([q] * len(near), near.tolist(), score.tolist(), at.tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64()))],
                ["query_id", "vec_id", "score", "leaf"],
            )

    found = index.mapInArrow(scan, "query_id long, vec_id long, score double, leaf long")
    return top(found, k)


def top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


class Index:
    """All vectors of a table in the leaves of one tree, stored in the shared folder."""

    def __init__(self, embeddings: DataFrame, k: int = 10, target: float = 0.97, id_col: str = "vec_id",
                 vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS):
        self.k, spark = k, embeddings.sparkSession
        self.vectors = materialize(usable(embeddings, id_col, vector_col), "vectors")
        known = materialize(entries(self.vectors, k), "entries")
        count = known.count()
        sample = known.orderBy(F.xxhash64(F.element_at("ids", 1)), F.element_at("ids", 1)).limit(sample_rows)
        held = [r["v"] for r in sample.select("v").toLocalIterator()]
        points = np.array(held, np.float64) if held else np.zeros((0, 1))
        leaves = max(1, min(-(-count // leaf_rows), len(points) // 4))
        self.tree = fit(points, leaves)
        tree = spark.sparkContext.broadcast(self.tree)

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf = tree.value.assign(_matrix(batch.column("v")))
                yield batch.append_column("leaf", pa.array(leaf, pa.int64())).append_column("run", pa.array(runs[leaf], pa.int64()))

        self._tree, runs = tree, self.tree.runs(SUBTREES)
        self.index = materialize(known.mapInArrow(put, "v array<double>, ids array<long>, leaf long, run long"), "leaves")
        self.visits, self.recall = self._calibrate(target)

    def _calibrate(self, target: float) -> tuple[int, float]:
        """Leaves to visit: doubled until enough true neighbours' leaves are reached."""
        leaves = self.tree.leaves
        if leaves == 1:
            return 1, 1.0
        chosen = self.vectors.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(CALIBRATION_ROWS).collect()
        queries = [(r["vec_id"], r["v"]) for r in chosen]
        order = {q: {leaf: n for n, leaf in enumerate(self.tree.visit(np.array(v), leaves))} for q, v in queries}
        found = exact(queries, self.index, self.k).select("query_id", "leaf").collect()  # k rows a query
        ranks = np.array([order[r["query_id"]][r["leaf"]] for r in found])
        visits = min(4, leaves)
        while visits < leaves and len(ranks) and (ranks < visits).mean() < target:
            visits = min(leaves, max(visits + 1, visits * 5 // 4))
        return visits, float((ranks < visits).mean()) if len(ranks) else 1.0

    def search(self, queries: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
        """(query_id, rank, vec_id, score) for rows (vec_id, v) of the index's own vectors."""
        tree, visits, k = self._tree, self.visits, self.k
        runs = self.tree.runs(SUBTREES)

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, later, run, leaves = [], [], [], []
                for row, q in enumerate(_matrix(batch.column("v"))):
                    found = np.array(tree.value.visit(q, visits), np.int64)
                    for phase, part in enumerate((found[:FIRST_LEAVES], found[FIRST_LEAVES:])):
                        for r in np.unique(runs[part]):
                            at.append(row)
                            later.append(phase)
                            run.append(r)
                            leaves.append(part[runs[part] == r])
                taken = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(taken), batch.column("v").take(taken), pa.array(later, pa.int32()),
                     pa.array(run, pa.int64()), pa.array(leaves, pa.list_(pa.int64()))],
                    ["vec_id", "v", "later", "run", "leaves"],
                )

        walked = queries.select("vec_id", "v").mapInArrow(walk, "vec_id long, v array<double>, later int, run long, leaves array<long>")
        asked = materialize(walked, "visits")
        never = F.lit(float("inf"))
        near = materialize(self._measured(asked.where("later = 0").withColumn("bound", never), group_rows), "first")
        if visits > FIRST_LEAVES:
            kth = top(near, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
            after = asked.where("later = 1").join(kth, "vec_id", "left").withColumn("bound", F.coalesce("bound", never))
            near = near.unionByName(self._measured(after, group_rows))
        return top(near, k).select("query_id", "rank", "vec_id", "score")

    def _measured(self, asked: DataFrame, group_rows: int) -> DataFrame:
        """(query_id, vec_id, score): of each run that a query asks, its k nearest within the bound."""
        k = self.k
        # one row for each run, so both counts can be broadcast
        rows = self.index.groupBy("run").agg(F.ceil(F.count("*") / group_rows).alias("row_groups"))
        wants = asked.groupBy("run").agg(F.ceil(F.count("*") / group_rows).alias("query_groups"))
        groups = F.broadcast(materialize(rows.join(wants, "run"), "groups"))
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = self.index.join(groups, "run").select(
            "run", F.pmod(F.xxhash64("ids"), "row_groups").alias("a"), upto("query_groups").alias("b"), "v", "ids", "leaf"
        )
        right = asked.join(groups, "run").select(
            "run", upto("row_groups").alias("a"), F.pmod(F.xxhash64("vec_id", "v"), "query_groups").alias("b"), "vec_id", "v", "leaves", "bound"
        )

        def measure(key: tuple, rows_: pa.Table, asks: pa.Table) -> pa.Table:
            out: list[tuple[int, np.ndarray, np.ndarray]] = []
            if rows_.num_rows and asks.num_rows:
                rows_ = rows_.sort_by("leaf")
                members, leaf = rows_.column("ids").combine_chunks(), rows_.column("leaf").to_numpy()
                v = _matrix(rows_.column("v").combine_chunks())
                flat, offsets = members.flatten().to_numpy(), members.offsets.to_numpy() - members.offsets[0].as_py()
                asked_ = zip(
                    asks.column("vec_id").to_pylist(), _matrix(asks.column("v").combine_chunks()), asks.column("leaves"),
                    asks.column("bound").to_pylist(), strict=True,
                )
                for q, x, leaves, bound in asked_:
                    want = leaves.values.to_numpy()
                    first, last = np.searchsorted(leaf, want, "left"), np.searchsorted(leaf, want, "right")
                    at = np.concatenate([np.arange(i, j) for i, j in zip(first, last, strict=True)])
                    if not len(at):
                        continue
                    sizes = offsets[at + 1] - offsets[at]
                    inside = np.repeat(offsets[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                    ids, score = closest(q, x, v[at], flat[inside], np.repeat(np.arange(len(at)), sizes), k)
                    near = score <= bound
                    out.append((q, ids[near], score[near]))
            joined = lambda i, t: np.concatenate([o[i] for o in out]) if out else np.zeros(0, t)
            return pa.table({
                "query_id": np.repeat(np.array([o[0] for o in out], np.int64), [len(o[1]) for o in out]),
                "vec_id": joined(1, np.int64), "score": joined(2, np.float64),
            })

        return left.groupBy("run", "a", "b").cogroup(right.groupBy("run", "a", "b")).applyInArrow(
            measure, "query_id long, vec_id long, score double"
        )


def neighbours(embeddings: DataFrame, k: int = 10, every: int = 100, target: float = 0.97, **options) -> DataFrame:
    """(query_id, rank, vec_id, score): k neighbours of the rows whose id is divisible by ``every``."""
    index = Index(embeddings, k, target, **options)
    return index.search(index.vectors.where(F.col("vec_id") % every == 0))
