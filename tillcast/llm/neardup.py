"""Near-duplicate documents by DartMinHash signatures and banded joining.

Elements are a document's different runs of five words, each of weight 1, so that weighted
similarity is their Jaccard similarity; ``dart_signatures`` takes any weights. Every element has
a half-plane of weight and rank in which darts fall as a Poisson process, the same for all
documents. A dart counts for a document if it lies below the element's weight there. Each dart
has a coordinate; the earliest dart of a coordinate is its value. The plane is cut into
regions whose darts follow from a hash, and the regions are opened in order of rank until every
coordinate has a dart, so the work is proportional to the elements plus K log K.

Equal texts are one node. Nodes that agree in a whole band of coordinates share a bucket.
Instead of all pairs of a bucket, every member is compared with the bucket's middle, the node with the
most bucket mates; whoever is then still in another component than the bucket's largest one meets the
members of other components by the rarest runs in which it differs from what most of them have. A pair
meets in no run only if it cannot be a link, or if both are linked to the same node. So no link is lost
that two bucket mates have, while a large group of copies costs its size and not its square. Pairs are screened by the agreement of their
signatures, then verified by the exact similarity of their runs (32-bit hashes of them).

Defined results: null, empty and blank texts are classes of their own; other equal texts are one
class, with or without words; a text of fewer than five words is one run of all its words.
Rows that repeat an id each get their class. The class id is the smallest doc_id of the class.
An empty table gives no rows. Other columns are not read, and ``deduplicated`` gives them back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tillcast.llm.common import as_long, components, forget, give_back, lists, mix, salted, shingles, text_chunks, word_hashes, wrapped
from tillcast.session import materialize

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
#: First rank cell; each of the others is as long as all before it.
FIRST_CELL = 0.25
#: Signatures' agreement may lie this far below the similarity: four standard deviations.
SLACK = 0.16
#: Rows up to which a list of ids is sent to every task: about 24 bytes a row.
BROADCAST_ROWS = 2_000_000
#: Allowance for sums of floats.
EPSILON = 1e-9

_POISSON: dict[float, np.ndarray] = {}


def _darts_in(area: float, uniform: np.ndarray) -> np.ndarray:
    """Number of darts in regions of this area, from uniform numbers."""
    if area not in _POISSON:
        most = int(area + 12 * np.sqrt(area) + 30)
        k = np.arange(most + 1)
        logs = k * np.log(area) - area - np.concatenate([[0.0], np.cumsum(np.log(k[1:]))])
        _POISSON[area] = np.cumsum(np.exp(logs))
    return np.searchsorted(_POISSON[area], uniform, side="right")


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def dart_signatures(elements: np.ndarray, weights: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """One row of ``size`` values for each set; a set without weight has zeros.

    Two sets agree in a coordinate with the probability of their weighted Jaccard similarity.
    """
    n = len(bounds) - 1
    out = np.zeros((n, size), np.uint64)
    filled = np.zeros((n, size), bool)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    live = weights > 0
    elements, weights, owner = elements[live], weights[live], owner[live]
    active = np.zeros(n, bool)
    active[owner] = True
    bands = int(np.ceil(np.log2(max(1.0, weights.max())))) + 1 if len(weights) else 0
    cell, start, length = 0, 0.0, FIRST_CELL
    while active.any():
        here = active[owner]
        parts = []
        for band in range(bands):
            low, high = (0.0, 1.0) if band == 0 else (2.0 ** (band - 1), 2.0**band)
            use = here if band == 0 else here & (weights > low)
            region = salted(elements[use], cell * 64 + band)
            count = _darts_in((high - low) * length, _uniform(region))
            which = np.repeat(np.arange(len(region)), count)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            dart = mix(region[which] + np.uint64(0xD6E8FEB86659FD93) * (nth + 1).astype(np.uint64))
            below = low + (high - low) * _uniform(salted(dart, 1)) < weights[use][which]
            parts.append((owner[use][which][below], dart[below]))
        of, dart = (np.concatenate(x) for x in zip(*parts, strict=True))
        rank = salted(dart, 2)  # inside one cell the order of ranks is all that counts
        at = of * size + (salted(dart, 3) % np.uint64(size)).astype(np.int64)
        open_ = ~filled.reshape(-1)[at]
        at, rank, dart = at[open_], rank[open_], dart[open_]
        order = np.lexsort((rank, at))
        at, dart = at[order], dart[order]
        first = np.ones(len(at), bool)
        first[1:] = at[1:] != at[:-1]
        out.reshape(-1)[at[first]] = dart[first]
        filled.reshape(-1)[at[first]] = True
        active &= ~filled.all(1)
        start += length
        length, cell = start, cell + 1
    return out


def runs_of(texts: list[str | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Different runs of words of each text, sorted, and their bounds."""
    flat, bounds = shingles(*word_hashes(texts), width, short=True)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    order = np.lexsort((flat, owner))
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    return flat[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(texts)))])


def _blank(text: Column) -> Column:
    return text.isNull() | (F.trim(F.regexp_replace(text, r"\s+", " ")) == "")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, text): equal texts have equal keys."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).where(~_blank(F.col("text"))).withColumn("key", F.unhex(F.md5("text")))


def signatures(texts: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, n, sketch, buckets) of every row (key, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for a, b, text in text_chunks(batch.column("text")):
                flat, bounds = runs_of(text, width)
                sig = dart_signatures(flat, np.ones(len(flat)), bounds, bands * rows)
                n = np.diff(bounds)
                keys = np.zeros((b - a, bands), np.uint64)
                for r in range(rows):
                    keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::rows])
                keys = mix(keys + np.arange(bands, dtype=np.uint64))
                held = np.where(n > 0, bands, 0)
                flat_keys = keys[n > 0].reshape(-1)
                sketch = np.ascontiguousarray((sig & np.uint64(0xFFFF)).astype("<u2"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(a, b - a), pa.array(n, pa.int32()), pa.array([s.tobytes() for s in sketch], pa.binary()),
                     lists(as_long(flat_keys), np.concatenate([[0], np.cumsum(held)]), pa.int64())],
                    ["key", "n", "sketch", "buckets"],
                )
        give_back()

    return texts.select("key", "text").mapInArrow(sign, "key binary, n int, sketch binary, buckets array<long>")


def _small(rows: DataFrame) -> DataFrame:
    """A broadcast hint where a stored list is proven to be short."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _agreeing(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose signatures may belong to texts that are similar enough."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(
        F.least("na", "nb") >= similarity * F.greatest("na", "nb")
    )

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in ("sa", "sb"))
                near = (a == b).mean(1) >= similarity - SLACK
                yield batch.select(["a", "b"]).filter(pa.array(near))

    return both.select("a", "b", "sa", "sb").mapInArrow(agree, "a long, b long")


def _runs_of_nodes(wanted: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(node, runs) of the wanted nodes (node, key): 32-bit hashes of their runs, stored."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, text in text_chunks(batch.column("text")):
                flat, bounds = runs_of(text, width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(a, b - a), lists((flat >> np.uint64(32)).astype(np.uint32).view(np.int32), bounds, pa.int32())],
                    ["node", "runs"],
                )
        give_back()

    once = texts.join(_small(materialize(wanted, "wanted")), "key").select("node", "text").mapInArrow(gather, "node long, runs array<int>")
    # copies of a text give the same runs; one of them is kept, combined before the shuffle
    return materialize(once.groupBy("node").agg(F.first("runs").alias("runs")), "runs")


def _meetings(mixed: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of different components among the rows (node, component, main) of one ``main`` that may be links.

    The runs that more than half of a main's nodes have are its centre, D(x) those in which x and the centre differ.
    Two nodes are a link if |D(x)| + |D(y)| - 2 |D(x) & D(y)| is at most k = (1 - s) / (1 + s) of
    their runs, s the similarity. So with slack(x) = |D(x)| - k |x| all whose slacks add up to 0 or less are links, and linked
    through the node of the least slack. All others share (slack(x) + slack(y)) / 2 runs of D or more, and
    meet by the rarest ones: as many of each node as leave too few for a link behind them.
    """
    member = materialize(mixed.select("main", "node", "component").distinct(), "members")
    runs = _runs_of_nodes(nodes.join(member.select("node").distinct(), "node").select("node", "key"), texts, width)
    held = member.join(runs.select("node", F.array_distinct("runs").alias("runs")), "node")
    often = held.select("main", F.explode("runs").alias("run")).groupBy("main", "run").agg(F.count("*").alias("n"))
    sizes = member.groupBy("main").agg(F.count("*").alias("size"))
    centres = often.join(sizes, "main").where("2 * n > size").groupBy("main").agg(F.collect_list("run").alias("centre"))
    apart = held.join(centres, "main", "left").withColumn("centre", F.coalesce("centre", F.expr("array()")))
    apart = materialize(apart.select(
        "main", "node", "component", F.size("runs").alias("n"),
        F.concat(F.array_except("runs", "centre"), F.array_except("centre", "runs")).alias("apart"),
    ), "apart")
    share = (1 - similarity) / (1 + similarity)
    placed = apart.select("main", "node", "component", "n", (F.size("apart") - share * F.col("n")).alias("slack"))
    best = placed.groupBy("main").agg(F.min(F.struct("slack", "node", "component")).alias("best"))
    placed = placed.join(best, "main")
    sure = placed.where(f"component <> best.component and slack + best.slack <= {EPSILON}").select(F.col("node").alias("x"), F.col("best.node").alias("y"))
    # runs that no other node of the main has are shared with none
    each = apart.select("main", "node", F.explode("apart").alias("run"))
    rare = each.groupBy("main", "run").agg(F.count("*").alias("holders")).where("holders > 1")
    order = each.join(rare, ["main", "run"]).groupBy("main", "node").agg(F.sort_array(F.collect_list(F.struct("holders", "run"))).alias("order"))
    least = F.greatest(F.lit(1), F.ceil((F.col("slack") + F.col("best.slack")) / 2 - EPSILON))
    firsts = placed.join(order, ["main", "node"]).withColumn("take", F.size("order") - least + 1).where("take > 0")
    firsts = firsts.select("main", "node", "component", "n", "slack", F.size("order").alias("all"), F.posexplode(F.expr("slice(order, 1, cast(take as int))")))
    firsts = materialize(firsts.select("main", "node", "component", "n", "slack", F.col("col.run").alias("run"), (F.col("all") - F.col("pos")).alias("left")), "firsts")
    side = lambda x: firsts.select("main", "run", *(F.col(c).alias(f"{c}{x}") for c in ("node", "component", "n", "slack", "left")))
    met = side("x").where("componentx <> main").join(side("y"), ["main", "run"]).where(
        (F.col("componentx") != F.col("componenty")) & ((F.col("componenty") == F.col("main")) | (F.col("nodex") < F.col("nodey")))
        & (F.least("nx", "ny") >= similarity * F.greatest("nx", "ny"))
        # of the first run that they share on, both have enough left
        & (F.least("leftx", "lefty") + EPSILON >= (F.col("slackx") + F.col("slacky")) / 2)
    )
    met = met.select(F.col("nodex").alias("x"), F.col("nodey").alias("y")).unionByName(sure)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _links(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs whose runs have the similarity, stored."""
    pairs = materialize(_agreeing(pairs, nodes, similarity), "pairs")
    named = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    runs = _runs_of_nodes(nodes.join(named, "node").select("node", "key"), texts, width)
    side = lambda x: runs.select(F.col("node").alias(x), F.col("runs").alias(f"r{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ra, rb = batch.column("ra"), batch.column("rb")
            ok = []
            for i in range(batch.num_rows):
                a, b = (x[i].values.to_numpy() for x in (ra, rb))
                common = len(np.intersect1d(a, b))
                a, b = len(np.unique(a)), len(np.unique(b))
                ok.append(common >= similarity * (a + b - common) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
        give_back()

    return materialize(both.select("a", "b", "ra", "rb").mapInArrow(verify, "a long, b long"), "links")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY,
            bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, key, component, class_id) of every row; ``key`` and ``component`` are null for blank texts."""
    keyed = _keyed(docs, id_col, text_col)
    signed = signatures(keyed, width, bands, rows)
    nodes = materialize(
        signed.groupBy("key").agg(*(F.first(c).alias(c) for c in ("n", "sketch", "buckets"))).withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    held = nodes.select("node", F.explode("buckets").alias("bucket"))
    shared = held.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    met = materialize(held.join(shared, "bucket"), "met")
    # the node with the most bucket mates lies in the middle of its group
    middle = met.join(met.groupBy("node").agg(F.sum("size").alias("mates")), "node")
    firsts = middle.groupBy("bucket").agg(F.max_by("node", "mates").alias("first"))
    members = materialize(met.join(firsts, "bucket").select("bucket", "node", "first"), "buckets")
    stars = members.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    links = _links(stars, nodes, keyed, width, similarity)
    labels = components(links, "a", "b")
    # whoever is outside its bucket's largest component meets those there that may be a link
    placed = members.join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    largest = parts.groupBy("bucket").agg(F.max(F.struct("size", "component"))["component"].alias("main"), F.count("*").alias("parts")).where("parts > 1")
    met = _meetings(placed.join(largest.drop("parts"), "bucket"), nodes, keyed, width, similarity)
    known = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = _links(met.join(known, ["a", "b"], "left_anti"), nodes, keyed, width, similarity)
    if more.limit(1).count():
        labels = components(links.unionByName(more), "a", "b")
    named = materialize(
        nodes.select("key", "node").join(labels, "node", "left").select("key", F.coalesce("component", "node").alias("component")), "named"
    )
    member = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    member = member.select("doc_id", F.when(~_blank(F.col("text")), F.unhex(F.md5("text"))).alias("key"))
    member = member.join(named, "key", "left")
    least = member.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("class_id"))
    return member.join(least, "component", "left").select("doc_id", "key", "component", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id) for every row: rows of one class are copies or near copies."""
    return classes(docs, **options).select("doc_id", "class_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class, that with the smallest id; columns as they were."""
    all_rows = materialize(classes(docs, id_col, text_col, **options), "classes")
    rows = all_rows.where("key is not null").groupBy("doc_id", "key").agg(
        F.first("component").alias("component"), F.first("class_id").alias("class_id"), F.count("*").alias("copies")
    )
    # of texts in one class that share its smallest id, the first one stays
    first = F.row_number().over(Window.partitionBy("component").orderBy("key"))
    kept = rows.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).withColumn("nth", first)
    repeated = materialize(kept.where("nth = 1 and copies > 1").select("doc_id", "key"), "repeated")
    gone = rows.where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id", "key").unionByName(kept.where("nth > 1").select("doc_id", "key"))
    gone = materialize(gone.unionByName(repeated), "gone")
    text = F.col(f"`{text_col}`").cast("string")
    keyed = wrapped(docs, doc_id=F.col(f"`{id_col}`"), key=F.when(~_blank(text), F.unhex(F.md5(text)))).alias("a")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key"))
    rest = keyed.join(_small(gone).alias("b"), same, "left_anti").select("row.*")
    again = keyed.join(_small(repeated).alias("b"), same).groupBy("a.doc_id", "a.key").agg(F.first("row").alias("row"))
    return rest.unionByName(again.select("row.*"))
