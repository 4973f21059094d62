"""Merkle manifest of a dataset: one root over all rows, and for each row the witness that proves it.

A row's leaf hashes its columns; a group's leaves form a tree of fan-out 3 and the groups' roots
another one above. Witnesses grow while leaves are appended: a new node is attached to the open
subtree beside its earlier siblings, takes them as the left half of its witness and is added to the
right half of theirs; a subtree that completes is appended one level up. A node's part is
shared by all leaves below it.

The leaves of a group are cut into aligned blocks of 3 ** 7, one task appends a block, and the blocks'
roots are appended in the same way, round after round, until a group has one node; the groups'
roots follow as one more group. A row's witness joins the parts of its rounds. No task sees more
than a block, however large a group is, and the number of rounds is the logarithm of the
largest group to the base 2187.

H is SHA-256 in lower-case hex of its inputs' concatenation, digests as hex text. A leaf is H of the
columns, each ``-`` if null, else byte count, ``:`` and value, so nulls differ from empty texts.
Groups ascend bytewise, null first; leaves ascend by id, null first, then by leaf. Rows that are
repeated are leaves of their own, told apart by position only, and any of them may take any of the
places. An empty table has no rows and no root. Columns other than the id, the group and those
hashed are not read; very long texts are hashed where they lie and never moved.
"""

from __future__ import annotations

from binascii import hexlify
from collections.abc import Callable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tillcast.llm.places import placed
from tillcast.session import materialize, small

FAN = 3
#: Levels that one task appends: blocks of 3 ** 7 = 2187 nodes.
LEVELS = 7
#: Blocks whose witnesses, about 1 KB each, are sent to every task at most.
BROADCAST_BLOCKS = 10_000

_STEP = pa.struct([("left", pa.binary()), ("right", pa.binary())])


class Node:
    """A digest, and its part of the witnesses of all leaves below it."""

    __slots__ = ("digest", "left", "right", "parent")

    def __init__(self, digest: bytes, left: bytes):
        self.digest, self.left, self.right, self.parent = digest, left, b"", None


def combine(digests: bytes) -> bytes:
    """H of some digests, given and returned as bytes."""
    return sha256(hexlify(digests)).digest()


class Appender:
    """The open subtrees of a block: at each level the nodes of a run that is not complete."""

    def __init__(self, fan: int = FAN):
        self.fan = fan
        self.open: list[list[Node]] = []

    def append(self, digest: bytes, level: int = 0) -> Node:
        if level == len(self.open):
            self.open.append([])
        run = self.open[level]
        node = Node(digest, b"".join(n.digest for n in run))
        for sibling in run:
            sibling.right += digest
        run.append(node)
        if len(run) == self.fan:
            self._complete(level)
        return node

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        parent = self.append(combine(b"".join(n.digest for n in run)), level + 1)
        for node in run:
            node.parent = parent

    def close(self, height: int | None = None) -> Node:
        """Complete the last runs; up to ``height`` levels, or until one node remains."""
        level = 0
        while True:
            alone = all(not run for run in self.open[level + 1 :]) and len(self.open[level]) == 1
            if alone and (height is None or level == height):
                return self.open[level][0]
            if self.open[level]:
                self._complete(level)
            level += 1


def leaf_of(columns: list[Column]) -> Column:
    """The leaf of some columns as bytes."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _block(fan: int, levels: int) -> Callable[[pa.Table], pa.Table]:
    """Append one block: every node with its witness inside the block, and one row for the root."""

    def append(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        height = levels if table.column("of")[0].as_py() > fan**levels else None
        subtrees = Appender(fan)
        nodes = [subtrees.append(d) for d in table.column("digest").to_pylist()]
        root = subtrees.close(height)
        left, right, bounds = [], [], [0]
        for node in nodes:
            while node is not root:
                left.append(node.left)
                right.append(node.right)
                node = node.parent
            bounds.append(len(left))
        steps = pa.StructArray.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], fields=list(_STEP))
        n = len(nodes)
        done = table.append_column("witness", pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), steps))
        done = done.append_column("is_root", pa.array([False] * n))
        own = {"tree": table.column("tree")[0].as_py(), "place": table.column("block")[0].as_py(),
               "of": -(-table.column("of")[0].as_py() // fan**levels), "digest": root.digest, "is_root": True}
        top = pa.table({f.name: pa.array([own.get(f.name)], f.type) for f in done.schema}, schema=done.schema)
        return pa.concat_tables([done, top])

    return append


def appended(nodes: DataFrame, fan: int = FAN, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """Append the nodes (tree, place, of, digest, ...) of all trees; ``of`` counts a tree's nodes.

    Returns the nodes of every round with their ``block`` and their ``witness`` inside it, and the
    trees' roots (tree, root).
    """
    block = fan**levels
    rounds = []
    while True:
        held = nodes.withColumn("block", F.floor(F.col("place") / F.lit(block)).cast("long"))
        schema = held.withColumns({
            "witness": F.expr("cast(null as array<struct<left: binary, right: binary>>)"), "is_root": F.lit(False),
        }).schema
        done = materialize(held.groupBy("tree", "block").applyInArrow(_block(fan, levels), schema), "appended")
        rounds.append(done.where("not is_root").drop("is_root"))
        nodes = done.where("is_root").select("tree", "place", "of", "digest")
        if nodes.where("of > 1").limit(1).count() == 0:
            return rounds, nodes.select("tree", F.col("digest").alias("root"))


def extended(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """The first round's nodes with whole witnesses: their own part, then those of the blocks above.

    ``top`` has (tree, place, witness, ...) with place 0 for each tree; its other columns are handed
    down. A tree has at most one block of nodes in the last round, and a block joins its own nodes
    only, so no join has a hot key.
    """
    handed = [c for c in top.columns if c not in ("tree", "place", "witness")]
    above = materialize(top, "above")
    for part in reversed(rounds):
        up = above.select(F.col("tree").alias("__t"), F.col("place").alias("__p"), F.col("witness").alias("__w"), *handed)
        above = part.join(small(up, BROADCAST_BLOCKS), (F.col("tree") == F.col("__t")) & (F.col("block") == F.col("__p")))
        above = above.withColumn("witness", F.concat("witness", "__w")).drop("__t", "__p", "__w", "block")
        if part is not rounds[0]:
            above = materialize(above, "above")
    return above


def fold(leaf: Column, witness: Column) -> Column:
    """The root that a leaf (bytes) and its witness give, as hex."""
    return F.aggregate(
        witness, F.lower(F.hex(leaf)),
        lambda acc, s: F.sha2(F.concat(F.lower(F.hex(s["left"])), acc, F.lower(F.hex(s["right"]))), 256),
    )


def manifest(docs: DataFrame, columns: list[str], group: str, key: str, fan: int = FAN, levels: int = LEVELS, **carried: Column) -> DataFrame:
    """(key, leaf, subroot, root, witness, ...) of every row; digests as hex, witnesses as bytes.

    ``carried`` names further values that are computed where the row lies and kept.
    """
    own = {"__key": F.col(key), "__group": F.col(group).cast("string"), "digest": leaf_of([F.col(c) for c in columns])}
    rows = materialize(docs.select(*(c.alias(n) for n, c in {**own, **carried}.items())), "leaves")
    leaves = placed(rows, "__group", ["__key", "digest"], numbered=True)
    leaves = leaves.withColumnsRenamed({"group_no": "tree", "group_size": "of"}).drop("__group")
    rounds, subroots = appended(leaves, fan, levels)
    subroots = materialize(subroots, "subroots")
    higher, roots = appended(subroots.select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(subroots.count()).cast("long").alias("of"),
        F.col("root").alias("digest"),
    ), fan, levels)
    none = F.expr("cast(array() as array<struct<left: binary, right: binary>>)")
    tops = extended(higher, roots.select("tree", F.lit(0).cast("long").alias("place"), none.alias("witness"), "root"))
    found = extended(rounds, tops.select(
        F.col("place").alias("tree"), F.lit(0).cast("long").alias("place"), "witness", F.col("digest").alias("subroot"), "root",
    ))
    hexed = [F.lower(F.hex(c)).alias(n) for c, n in (("digest", "leaf"), ("subroot", "subroot"), ("root", "root"))]
    return found.select(F.col("__key").alias(key), *hexed, "witness", *carried)


def verified(docs: DataFrame) -> DataFrame:
    """Prove every document against the root, half of them after their line breaks are deleted."""
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = leaf_of([F.col(c) for c in columns[:-1]] + [F.replace(F.col("text"), F.lit("\n"), F.lit(""))])
    told = F.when(touched & F.contains(F.col("text"), F.lit("\n")), changed)
    rows = manifest(docs, columns, "source", "doc_id", told=told)
    siblings = F.array_join(F.transform("witness", lambda s: F.lower(F.hex(F.concat(s["left"], s["right"])))), "")
    folded = fold(F.coalesce(F.col("told"), F.unhex("leaf")), F.col("witness"))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
