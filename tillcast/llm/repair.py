"""Repair of conversation structure by the cheapest edits, over grammar-compressed role sequences.

A conversation's rows become one symbol each: the role's initial, whether the row must go (blank or
a duplicate) and whether its text is cut off. The sequences are cut into blocks, equal blocks are
kept once, and Re-Pair replaces the most frequent adjacent pairs by rules, several disjoint pairs
a round. A symbol has a min-plus transfer matrix over the states of the wanted form: the least cost
from state to state, with the audit of its edits. A rule's matrix is the product of its two
symbols', with a rope of their audits; rules are evaluated bottom-up, once for all
conversations. Blocks of one conversation are multiplied in a tree of fan-in 64, and the states
chosen at the top go down again, so that every block learns its edits.

Wanted are initials ``(s?(ua)+)?``. Keep costs 0, Rerole to user or assistant 3, Delete 4, Insert of
an empty user or assistant turn 3, and a row that is cut off costs 3 more unless it is deleted.
Of equally cheap audits the ASCII-least is taken. Two equally cheap audits of the same rows and
states are never prefixes of each other (the letters fix the cost), so the least one of a
product is made of the least ones of its parts.

Rows are taken by turn, nulls first, then by role and text; null roles and texts are one space. A
null conversation id is a conversation. A role's initial is its first character, none where it is
empty. Repeated rows are duplicates. Texts of any length are moved once to be placed and
once to be read in order; columns other than the four are not read. An empty table gives none.
Rows of a conversation of any length spread over many tasks, but its audit is one value and its digest is
one running hash over one sorted stream, as their definitions ask.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tillcast.llm.places import placed
from tillcast.session import materialize

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
#: Rows of a block, blocks that are multiplied at once.
BLOCK_ROWS = 1024
FAN_IN = 64
#: Bytes of all sequences' matrices up to which they are sent to every task.
BROADCAST_BYTES = 8 << 20
#: Rounds of Re-Pair and rules of a round; what they leave is multiplied symbol by symbol.
ROUNDS = 8
RULES_A_ROUND = 32
#: The first rule's character; the symbols are s u a o, in capitals where cut off, and x.
_FIRST_RULE = 0x4E00

#: States: nothing yet, after s, after u, after ua. NEXT[state][initial] is the state after it.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTED = (0, 3)
_BLANK = r"\A[\x20\x09-\x0D]*\z"
_MEET = ("su", "ua", "au")
_NAMES = {"u": "user", "a": "assistant"}

Cell = tuple  # (cost, rope)


class Rope:
    """A text kept as two ropes, written out when it is first compared or read."""

    __slots__ = ("left", "right", "_text")

    def __init__(self, left: Rope | None = None, right: Rope | None = None, text: str | None = None):
        self.left, self.right, self._text = left, right, text

    def text(self) -> str:
        if self._text is None:
            self._text = self.left.text() + self.right.text()
            self.left = self.right = None
        return self._text


def _better(a: Cell | None, b: Cell | None) -> Cell | None:
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if a[1].text() <= b[1].text() else b


def product(a: list, b: list) -> list:
    """The min-plus product of two matrices, flat by rows."""
    n = len(NEXT)
    out: list = [None] * (n * n)
    for i in range(n):
        for m in range(n):
            if (x := a[i * n + m]) is None:
                continue
            for j in range(n):
                if (y := b[m * n + j]) is not None:
                    best = out[i * n + j]
                    if best is None or x[0] + y[0] <= best[0]:
                        out[i * n + j] = _better(best, (x[0] + y[0], Rope(x[1], y[1])))
    return out


@cache
def inserts() -> list:
    """The cheapest insertions from state to state; a cycle is never worth its cost."""
    n = len(NEXT)
    out: list = [None] * (n * n)
    for i in range(n):
        state, k = i, 0
        while out[i * n + state] is None:
            out[i * n + state] = (INSERT * k, Rope(text="I" * k))
            state, k = next(s for c, s in NEXT[state].items() if c in _NAMES), k + 1
    return out


@cache
def symbol_matrix(symbol: str) -> list:
    """Insertions before a row, then its own edit."""
    n = len(NEXT)
    own: list = [None] * (n * n)
    late = CUT_OFF if symbol.isupper() else 0
    for i in range(n):
        own[i * n + i] = (DELETE, Rope(text="D"))
        if symbol == "x":
            continue
        for initial, j in NEXT[i].items():
            if initial in _NAMES:
                own[i * n + j] = _better(own[i * n + j], (REROLE + late, Rope(text="R")))
            if initial == symbol.lower():
                own[i * n + j] = _better(own[i * n + j], (KEEP + late, Rope(text="K")))
    return product(inserts(), own)


def matrices(rules: dict[str, tuple[str, str]]) -> dict[str, list]:
    """The matrices of all symbols and rules; a rule comes after the two it is made of."""
    out = {s: symbol_matrix(s) for s in "suaoSUAOx"}
    for rule, (left, right) in rules.items():
        out[rule] = product(out[left], out[right])
    return out


def _one() -> list:
    n = len(NEXT)
    return [(0, Rope(text="")) if i == j else None for i in range(n) for j in range(n)]


def repair_pairs(sequences: DataFrame, rounds: int = ROUNDS, most: int = RULES_A_ROUND) -> tuple[DataFrame, dict[str, tuple[str, str]]]:
    """(seq, packed) of different sequences, and the rules: symbol to the two it stands for.

    A round takes the most frequent pairs that share no symbol and replaces them from the left. The
    pair counts stay in Spark; only the rules, at most ``rounds * most``, reach the driver.
    """
    rules: dict[str, tuple[str, str]] = {}
    held = sequences.select("seq", F.col("seq").alias("packed"))
    for _ in range(rounds):
        pairs = (
            held.where(F.length("packed") > 1)
            .select(F.explode(F.expr("transform(sequence(1, length(packed) - 1), i -> substring(packed, i, 2))")).alias("pair"))
            .groupBy("pair").count().where("count > 1").orderBy(F.desc("count"), "pair").limit(4 * most)
        )
        taken: set[str] = set()
        packed = F.col("packed")
        found = 0
        for pair in [r.pair for r in pairs.collect()]:
            if found < most and not taken & set(pair):
                taken |= set(pair)
                rule = chr(_FIRST_RULE + len(rules))
                rules[rule] = (pair[0], pair[1])
                packed = F.replace(packed, F.lit(pair), F.lit(rule))
                found += 1
        if not found:
            break
        held = materialize(held.withColumn("packed", packed), "packed")
    return held, rules


def _cells(matrix: list) -> tuple[list, list]:
    return [c and c[0] for c in matrix], [c and c[1].text() for c in matrix]


def evaluated(sequences: DataFrame, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """(seq, costs, audits): the matrix of every sequence, from those of its rules."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = matrices(rules)
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                costs, audits = [], []
                for packed in batch.column("packed").to_pylist():
                    matrix = known[packed[0]] if packed else _one()
                    for symbol in packed[1:]:
                        matrix = product(matrix, known[symbol])
                    c, a = _cells(matrix)
                    costs.append(c)
                    audits.append(a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("seq"), pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))],
                    ["seq", "costs", "audits"],
                )

    return sequences.select("seq", "packed").mapInArrow(multiply, "seq string, costs array<long>, audits array<string>")


_NODE = "conv long, tier int, node long, up long, costs array<long>, audits array<string>, paths array<array<int>>"


def _combine(table: pa.Table) -> pa.Table:
    """The product of up to ``FAN_IN`` consecutive blocks, with the states between them."""
    table = table.sort_by("node")
    n = len(NEXT)
    total, paths = None, None
    for costs, audits in zip(table.column("costs").to_pylist(), table.column("audits").to_pylist(), strict=True):
        matrix = [None if c is None else (c, Rope(text=a)) for c, a in zip(costs, audits, strict=True)]
        if total is None:
            total, paths = matrix, [[] if c else None for c in matrix]
            continue
        after, ways = [None] * (n * n), [None] * (n * n)
        for i in range(n):
            for m in range(n):
                if (x := total[i * n + m]) is None:
                    continue
                for j in range(n):
                    if (y := matrix[m * n + j]) is not None:
                        cell = (x[0] + y[0], Rope(x[1], y[1]))
                        if _better(after[i * n + j], cell) is cell:
                            after[i * n + j], ways[i * n + j] = cell, [*paths[i * n + m], m]
        total, paths = after, ways
    costs, audits = _cells(total)
    row = {"conv": table.column("conv")[0].as_py(), "tier": table.column("tier")[0].as_py() + 1,
           "node": table.column("up")[0].as_py(), "up": table.column("up")[0].as_py() // FAN_IN, "costs": costs, "audits": audits, "paths": paths}
    kinds = {"conv": pa.int64(), "tier": pa.int32(), "node": pa.int64(), "up": pa.int64(), "costs": pa.list_(pa.int64()),
             "audits": pa.list_(pa.string()), "paths": pa.list_(pa.list_(pa.int32()))}
    return pa.table({k: pa.array([row[k]], kind) for k, kind in kinds.items()})


def _exit(costs: Column, audits: Column) -> Column:
    """The best end of a whole conversation: (cost, audit, state it ends in before closing)."""
    ends = []
    for state in range(len(NEXT)):
        for last in ACCEPTED:
            if (more := inserts()[state * len(NEXT) + last]) is not None:
                ends.append(F.struct(
                    (costs[state] + more[0]).alias("cost"), F.concat(audits[state], F.lit(more[1].text())).alias("audit"), F.lit(state).alias("state"),
                ))
    return F.array_min(F.filter(F.array(*ends), lambda e: e["cost"].isNotNull()))


def decided(blocks: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Costs and audits (conv, cost, audit) and each block's edits (conv, block, seq, entry, piece).

    ``blocks`` has (conv, block, n_blocks, seq). A conversation of one block takes its sequence's
    matrix; only longer ones are multiplied, tier by tier.
    """
    letters = cells.agg(F.sum(F.length(F.array_join("audits", "", "")) + 200)).first()[0] or 0
    cells = F.broadcast(cells) if letters <= BROADCAST_BYTES else cells
    held = materialize(blocks.join(cells, "seq"), "cells")
    n = len(NEXT)
    best = _exit(F.col("costs"), F.col("audits"))
    single = held.where("n_blocks = 1").withColumn("best", best)
    totals = single.select("conv", "best.cost", "best.audit")
    pieces = single.select("conv", "block", "seq", F.lit(0).alias("entry"), F.element_at("audits", F.col("best.state") + 1).alias("piece"))
    tiers = [held.where("n_blocks > 1").select(
        "conv", F.lit(0).alias("tier"), F.col("block").alias("node"), F.floor(F.col("block") / FAN_IN).cast("long").alias("up"), "costs", "audits",
        F.lit(None).cast("array<array<int>>").alias("paths"), "seq",
    )]
    if tiers[0].limit(1).count() == 0:
        return totals, pieces
    while tiers[-1].where("node > 0").limit(1).count():
        tiers.append(materialize(tiers[-1].drop("seq").groupBy("conv", "up").applyInArrow(_combine, _NODE), "tier"))
    tops = tiers[-1].withColumn("best", best)
    totals = totals.unionByName(tops.select("conv", "best.cost", "best.audit"))
    chosen = tops.select("conv", "node", F.lit(0).alias("entry"), F.col("best.state").alias("leave"))
    for tier in range(len(tiers) - 1, 0, -1):
        at = F.col("entry") * n + F.col("leave") + 1
        path = F.element_at("paths", at)
        states = F.concat(F.array(F.col("entry")), path, F.array(F.col("leave")))
        parents = tiers[tier].join(chosen.withColumnsRenamed({"conv": "__c", "node": "__n"}), F.col("conv").eqNullSafe(F.col("__c")) & (F.col("node") == F.col("__n")))
        chosen = materialize(parents.select(
            "conv", F.col("node").alias("up"), F.posexplode(F.slice(states, 1, F.size(states) - 1)).alias("k", "entry"), states.alias("states"),
        ).select("conv", (F.col("up") * FAN_IN + F.col("k")).alias("node"), "entry", F.element_at("states", F.col("k") + 2).alias("leave")), "chosen")
    leaves = tiers[0].join(chosen.withColumnsRenamed({"conv": "__c", "node": "__n"}), F.col("conv").eqNullSafe(F.col("__c")) & (F.col("node") == F.col("__n")))
    longer = leaves.select(
        "conv", F.col("node").alias("block"), "seq", "entry", F.element_at("audits", F.col("entry") * n + F.col("leave") + 1).alias("piece"),
    )
    return totals, pieces.unionByName(longer)


def _edits(seq: str, entry: int, piece: str) -> tuple[list[str], int]:
    """What a block's audit does to each row: inserted roles in lower case, then D, K, or R and a role."""
    out, state, at = [], entry, 0
    for symbol in seq:
        edit = ""
        while piece[at] == "I":
            initial = next(c for c in NEXT[state] if c in _NAMES)
            edit, state, at = edit + initial, NEXT[state][initial], at + 1
        letter, at = piece[at], at + 1
        if letter != "D":
            initial = symbol.lower() if letter == "K" else next(c for c in NEXT[state] if c in _NAMES)
            state = NEXT[state][initial]
            letter += initial if letter == "R" else ""
        out.append(edit + letter)
    return out, state


def edits(pieces: DataFrame) -> DataFrame:
    """(conv, block, edits): one entry for each row of a block."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("seq", "entry", "piece")), strict=True)
            found = [_edits(*row)[0] for row in rows]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("block"), pa.array(found, pa.list_(pa.string()))], ["conv", "block", "edits"])

    return pieces.mapInArrow(spell, "conv long, block long, edits array<string>")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text) after the faults that the rows' checksums pick; see the registered query."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    pick = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    rows = conversations.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), plain("role").alias("role"), plain("text").alias("text"), pick.alias("pick"),
    ).where("pick <> 0")
    text = F.when(F.col("pick") == 1, "").when(F.col("pick") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("pick") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv", "turn", F.when(F.col("pick") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies)).drop("col")


def diagnosed(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Rows (conv, turn, role, text) with place and block: their first faults, stored, and their texts."""
    texts = placed(rows, "conv", ["turn", "role", "text"]).withColumn("block", F.floor(F.col("place") / F.lit(block_rows)).cast("long"))
    narrow = materialize(texts.select(
        "conv", "turn", "role", "place", "block", "group_size", F.sha2("text", 256).alias("digest"),
        F.col("text").rlike(_BLANK).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"),
    ), "diagnosed")
    # the first of equal rows: counted before the shuffle, and joined back row by row
    first = narrow.groupBy("conv", "role", "digest").agg(F.min("place").alias("__p")).select(F.col("conv").alias("__c"), "__p")
    found = narrow.join(first, F.col("conv").eqNullSafe(F.col("__c")) & (F.col("place") == F.col("__p")), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("__p").isNull(), "duplicate").when(F.col("cut"), "truncated")
    faults = materialize(found.select("conv", "turn", "role", "place", "block", "group_size", fault.alias("fault")), "faults")
    return faults, texts.select("conv", "place", "block", "role", "text")


def _blocks(faults: DataFrame, block_rows: int) -> DataFrame:
    """(conv, block, n_blocks, seq, first, last, inside) of the rows in order, at most a block's rows a value.

    ``first`` and ``last`` are the initials at the ends, ``inside`` counts the pairs between that may not meet.
    """
    initial = F.substring("role", 1, 1)
    kept = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(kept)).otherwise(kept)
    rows = faults.select("conv", "block", "group_size", F.struct("place", symbol.alias("symbol"), initial.alias("initial")).alias("r"))
    ordered = rows.groupBy("conv", "block").agg(F.array_sort(F.collect_list("r")).alias("r"), F.max("group_size").alias("n"))
    initials = F.col("r.initial")
    pairs = F.transform(F.slice(initials, 2, F.size("r") - 1), lambda x, k: F.concat(F.get(initials, k), x))
    return ordered.select(
        "conv", "block", F.ceil(F.col("n") / block_rows).cast("long").alias("n_blocks"),
        F.array_join(F.col("r.symbol"), "").alias("seq"), F.element_at(initials, 1).alias("first"), F.element_at(initials, -1).alias("last"),
        F.size(F.filter(pairs, lambda p: ~p.isin(*_MEET))).cast("long").alias("inside"),
    )


def repaired(rows: DataFrame, block_rows: int = BLOCK_ROWS, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Diagnose and repair conversations (conv, turn, role, text).

    Returns one row a conversation (conv, gaps, blank, duplicate, truncated, illegal, cost, audit) and
    the repaired turns (conv, place, step, role, text), in order of place and step.
    """
    faults, texts = diagnosed(rows, block_rows)
    blocks = materialize(_blocks(faults, block_rows), "blocks")
    packed, rules = repair_pairs(materialize(blocks.select("seq").distinct(), "sequences"), rounds)
    cells = materialize(evaluated(packed, rules), "matrices")
    totals, pieces = decided(blocks.select("conv", "block", "n_blocks", "seq"), cells)
    totals = materialize(totals, "totals")

    before = F.lag("last").over(W.partitionBy("conv").orderBy("block"))
    meets = F.concat(before, F.col("first"))
    illegal = blocks.select("conv", (F.col("inside") + F.when(~meets.isin(*_MEET), 1).otherwise(0)).alias("n")).groupBy("conv").agg(
        F.sum("n").cast("long").alias("illegal")
    )
    counts = faults.groupBy("conv").agg(
        F.expr("try_cast(coalesce(cast(max(turn) as decimal(20,0)) - cast(min(turn) as decimal(20,0)) + 1 - count(distinct turn), 0) as bigint)").alias("gaps"),
        *(F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")),
    )
    report = counts
    for more in (illegal, totals):
        more = more.withColumnRenamed("conv", "__c")
        report = report.join(more, F.col("conv").eqNullSafe(F.col("__c"))).drop("__c")

    steps = edits(pieces).withColumnsRenamed({"conv": "__c", "block": "__b"})
    done = texts.join(materialize(steps, "edits"), F.col("conv").eqNullSafe(F.col("__c")) & (F.col("block") == F.col("__b")))
    edit = F.element_at("edits", (F.col("place") - F.col("block") * block_rows + 1).cast("int"))
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    name = lambda c: F.when(c == "u", "user").otherwise("assistant")
    added = F.filter(F.split(F.regexp_extract(F.col("edit"), "^([ua]*)", 1), ""), lambda c: c != "")
    added = F.transform(added, lambda c: turn(name(c), F.lit("")))
    own = F.when(F.col("edit").contains("D"), F.expr("cast(array() as array<struct<role: string, text: string>>)")).otherwise(
        F.array(turn(F.when(F.col("edit").contains("K"), F.col("role")).otherwise(name(F.substring(F.col("edit"), -1, 1))), F.col("text")))
    )
    turns = done.withColumn("edit", edit).select("conv", "place", F.posexplode(F.concat(added, own)).alias("step", "t")).select(
        "conv", "place", "step", "t.role", "t.text"
    )
    closing = F.length(F.regexp_extract("audit", "(I*)$", 1))
    last = F.lit(2**62).cast("long")
    names = F.when(closing == 1, F.array(F.lit("assistant"))).otherwise(F.array(F.lit("user"), F.lit("assistant")))
    turns = turns.unionByName(totals.where(closing > 0).select("conv", last.alias("place"), F.posexplode(names).alias("step", "role"), F.lit("").alias("text")))
    return report, turns


def digests(turns: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): each conversation's ``role:text`` lines, hashed as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done = (), None, []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
                if (conv,) != current:
                    if state:
                        done.append((*current, state.hexdigest()))
                    current, state = (conv,), hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())], ["conv", "repaired_sha256"])
            done = []
        if state:
            yield pa.RecordBatch.from_arrays([pa.array(list(current), pa.int64()), pa.array([state.hexdigest()])], ["conv", "repaired_sha256"])

    ordered = turns.repartition("conv").sortWithinPartitions("conv", "place", "step")
    return ordered.select("conv", "role", "text").mapInArrow(run, "conv long, repaired_sha256 string")


def damage_and_repair(conversations: DataFrame, block_rows: int = BLOCK_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """Damage the rows by their checksums, repair them, and report every original conversation."""
    report, turns = repaired(damaged(conversations), block_rows, rounds)
    hashes = digests(turns).withColumnRenamed("conv", "__h")
    report = report.join(hashes, F.col("conv").eqNullSafe(F.col("__h")), "left").drop("__h")
    all_ = conversations.select("conv_id").distinct()
    found = all_.join(report, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return found.select(
        "conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
