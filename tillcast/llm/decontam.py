r"""Benchmark decontamination by templates, with DataFrame functions only.

Documents and benchmark items become templates: words in lower case without punctuation, where
numbers, names (capitalised words inside a sentence) and units (after a number) are typed
placeholders. Runs of ``width`` template words are joined by hash, but for those with fewer than two
plain words, which would match anything. All runs are also joined by their original words, so a
copy in other case or layout is found. A wide template takes every capitalised word as a name,
neighbouring ones as one, and spelt numbers in any case. A run counts if any key matches. White
space is one blank.

Along each alignment of a document and an item (the same distance between their places) the
slots must be consistent: an item's slot value stands against one value of the document
only. Consistent alignments count, whether the values are equal (the item itself) or changed (a
re-parameterised one). A document is contaminated by an item if they cover ``coverage`` of
the item's runs or more.

A first pass finds the documents that share any run with the benchmark, by hashes alone; only
these are read again, with their words. The benchmark's runs are broadcast only up to
``BROADCAST_RUNS`` of them; beyond that both passes join by a shuffle.
Equal runs of a document and an item are combined before the shuffle, so neither a hot run nor a
document that repeats a third of the table gathers in one task.

Null and empty texts and items have no runs. An item of fewer words than ``width`` is one run
of all its words. Items that repeat an id are judged one by one; repeated documents each get
their rows. Empty tables give no rows. Columns other than identifiers and texts are not read,
and ``clean`` gives them back as they were.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tillcast.llm.common import wrapped
from tillcast.session import materialize

WIDTH = 5
COVERAGE = 0.8
#: Runs of the benchmark up to which they are sent to every task: 40 bytes or so each.
BROADCAST_RUNS = 200_000
#: Documents up to which a list of hashes is sent to every task.
BROADCAST_SUSPECTS = 2_000_000

NUMBER, NAME, UNIT, JOIN = "\ue000", "\ue001", "\ue002", "\ue003"
UNITS = (
    "km|m|cm|mm|kg|g|mg|t|lb|lbs|oz|ft|in|yd|mi|l|ml|s|ms|h|min|hz|khz|mhz|ghz|w|kw|kwh|v|a|pa|bar|k|c|f|"
    "miles?|met(?:er|re)s?|kilomet(?:er|re)s?|centimet(?:er|re)s?|grams?|kilograms?|pounds?|ounces?|feet|foot|inch(?:es)?|"
    "yards?|lit(?:er|re)s?|gallons?|seconds?|minutes?|hours?|days?|weeks?|months?|years?|degrees?|percent|"
    "dollars?|cents?|euros?|mph|kmh"
)
NUMBER_WORDS = (
    "zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|"
    "seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion"
)


def _by_first_letter(words: str) -> str:
    """The same words as alternatives by their first letter, so that few are tried at a place.

    Only for words that are followed by no letter: then at most one of them fits, in whatever order.
    """
    by: dict[str, list[str]] = {}
    for word in words.split("|"):
        by.setdefault(word[0], []).append(word[1:])
    return "|".join(f"{letter}(?:{'|'.join(rest)})" for letter, rest in by.items())


_SPELT = _by_first_letter(NUMBER_WORDS)
#: What a number may start with; an assertion in front of the dearer ones, as is a capital's in ``_CAPITAL``.
_MAY_BE_NUMBER = r"(?=[-+$€£(\[\"'\p{N}])"
_CAPITAL = r"(?=\p{Lu}\p{Ll})(?<![^\s\p{Ps}\p{Pi}\"'])"


def _folded(text: str) -> Column:
    """A text with each run of white space as one blank; a blank that stands alone is no match and costs nothing."""
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\t\n\x0B\f\r]\s*| \s+", " ")


def _worded(rows: DataFrame, source: str, name: str) -> DataFrame:
    """Replace text column ``source`` by its words; what is punctuation only is no word.

    The steps are columns of their own: one that is used twice is then computed once.
    """
    plain = F.trim(F.regexp_replace(F.lower(source), r"\p{Punct}+", ""), F.lit(" \t\n\r\x0b\x0c"))
    split = F.when(F.col(source) != "", F.split(source, r"\s+")).otherwise(F.array().cast("array<string>"))
    return rows.withColumn(source, plain).withColumn(name, split).drop(source)


def with_words(rows: DataFrame, text: str, name: str = "w") -> DataFrame:
    """Add the words of a text column."""
    return _worded(rows.withColumn("__w", F.coalesce(F.col(text).cast("string"), F.lit(""))), "__w", name)


def with_template(rows: DataFrame, text: str, name: str = "t") -> DataFrame:
    """Add the words with placeholders; place by place the same as ``with_words``.

    Each pattern starts with what is rare in a text, so most places fail at their first character.
    """
    folded = _folded(text)
    named = F.regexp_replace(folded, r"\p{Lu}(?<=[^\s.!?:] .)\p{Ll}[\p{L}\p{M}'’-]*", NAME)
    spelt = F.regexp_replace(named, rf"(?=[zotfsenhmb])\b(?:{_SPELT})(?![\p{{L}}\p{{N}}])", NUMBER)
    measured = F.regexp_replace("__t", rf"(\p{{N}} )(?i:{UNITS})(?![\p{{L}}\p{{N}}])", f"$1{UNIT}")
    numbered = F.regexp_replace(measured, _MAY_BE_NUMBER + r"(?<!\S)[-+$€£(\[\"']{0,3}\p{N}\S*", NUMBER)
    out = rows.withColumn("__t", spelt).withColumn("__t", F.when(F.rlike("__t", F.lit(r"\p{N}")), numbered).otherwise(F.col("__t")))
    return _worded(out, "__t", name)


def _joined(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Add the text with the words of each name joined, so that a name of any length is one word."""
    plain = _folded(text)
    named = rf"(?=\p{{Lu}}\p{{Ll}})(?!(?i:{_SPELT})(?![\p{{L}}\p{{N}}]))\p{{Lu}}\p{{Ll}}"
    return rows.withColumn(name, F.regexp_replace(plain, rf"{_CAPITAL}({named}[\p{{L}}\p{{M}}'’-]*) (?={named})", f"$1{JOIN}"))


def with_names(rows: DataFrame, text: str, name: str = "f") -> DataFrame:
    """Add the wide template and, as ``name`` + "w", the words beside it.

    Every capitalised word is a name, also at a sentence start, neighbouring ones are one name, spelt
    numbers are in any case, and units follow either kind of number.
    """
    rows = _joined(rows, text, "__j")
    spelt = F.regexp_replace("__j", rf"(?=[zotfsenhmbZOTFSENHMB])\b(?i)(?:{_SPELT})(?:-(?:{_SPELT}))*(?![\p{{L}}\p{{N}}])", NUMBER)
    named = F.regexp_replace("__f", rf"{_CAPITAL}\p{{Lu}}\p{{Ll}}[\p{{L}}\p{{M}}'’{JOIN}-]*", NAME)
    measured = F.regexp_replace("__f", rf"([\p{{N}}{NUMBER}] )(?i:{UNITS})(?![\p{{L}}\p{{N}}])", f"$1{UNIT}")
    numbered = F.regexp_replace(measured, _MAY_BE_NUMBER + r"(?<!\S)[-+$€£(\[\"']{0,3}\p{N}\S*", NUMBER)
    out = rows
    for step in (spelt, named, F.when(F.rlike("__f", F.lit(rf"[\p{{N}}{NUMBER}]")), numbered).otherwise(F.col("__f"))):
        out = out.withColumn("__f", step)
    return with_words(_worded(out, "__f", name), "__j", f"{name}w").drop("__j")


#: The kinds of runs and how their arrays are made; the array of original words beside each.
KINDS = {"t": with_template, "w": with_words, "f": with_names}
WORDS = {"t": "w", "w": "w", "f": "fw"}


def _slots(name: str, width: int) -> Column:
    """Placeholders in the run that starts at ``at``."""
    return sum((F.col(name)[F.col("at") + k].isin(NUMBER, NAME, UNIT).cast("int") for k in range(width)), F.lit(0))


def _key(kind: str, width: int, any_run: bool = False) -> Column:
    """Hash of the run that starts at ``at``; null for a template that would match anything.

    With ``any_run`` such templates have their hash too, which no key of the benchmark equals.
    """
    key = F.xxhash64(F.lit(kind), F.lit(width), *(F.col(kind)[F.col("at") + k] for k in range(width)))
    return key if kind == "w" or any_run else F.when(_slots(kind, width) <= width - 2, key)


def _with_all(rows: DataFrame, text: str) -> DataFrame:
    """Add the arrays of all kinds and drop the text."""
    return with_names(with_template(with_words(rows, text), text), text).drop(text)


def _placed(rows: DataFrame, kind: str, width: int) -> DataFrame:
    """One row for each place of a run. A filter on the number of words, also one that the optimizer
    would put in front of an inner explode, would compute the template a second time."""
    places = F.when(F.size(kind) >= width, F.sequence(F.lit(0), F.size(kind) - width))
    return rows.select("*", F.explode_outer(places).alias("at")).where("at is not null")


def _runs(rows: DataFrame, kind: str, width: int) -> DataFrame:
    """One row for each run of ``width`` words: its place, its key and its own few words.

    The document's arrays are left behind here, so a row stays small however long the text is; in
    front of a broadcast join the generated loop takes the words of matching runs only.
    """
    words = WORDS[kind]
    cut = lambda name: F.slice(name, F.col("at") + 1, width)
    kept = [c for c in rows.columns if c not in KINDS and c not in WORDS.values()]
    return _placed(rows, kind, width).select(
        *kept, F.lit(kind).alias("kind"), "at", _key(kind, width).alias("key"), cut(words).alias("run"), cut(kind).alias("run_template")
    ).where("key is not null")


def _benchmark(benchmark: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, list[tuple[str, int]]]:
    """Runs of all items with the number of runs of their item, stored; and the kinds and widths in use."""
    items = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("x")).distinct()
    items = _with_all(items.withColumn("item", F.xxhash64("item_id", "x")), "x")
    items = materialize(items.withColumn("runs", F.size("w") - F.least(F.size("w"), F.lit(width)) + 1), "items").where("size(w) > 0")
    used, runs = [], None
    for kind in KINDS:
        sized = items.withColumn("all_words", F.col(WORDS[kind])).withColumn("width", F.least(F.size(kind), F.lit(width)))
        for n in sorted(r["width"] for r in sized.select("width").distinct().collect()):  # ``width`` values at most
            own = _runs(sized.where(F.col("width") == n), kind, n).withColumn("covers", _covers(kind))
            own = own.select("item_id", "item", "kind", "width", "runs", F.col("at").alias("place"), "covers", "key",
                             F.col("run").alias("item_words"), F.col("run_template").alias("item_template"))
            runs = own if runs is None else runs.unionByName(own)
            used.append((kind, n))
    if not used:
        return benchmark.sparkSession.createDataFrame(
            [], "item_id long, item long, kind string, width int, runs int, place int, covers array<int>, key long, item_words array<string>, item_template array<string>"
        ), []
    return materialize(runs, "item_runs"), used


def _covers(kind: str) -> Column:
    """The item's places that a run at ``at`` covers, in words as they are; a joined name has several."""
    if kind != "f":
        return F.array("at")
    parts = lambda words: F.aggregate(words, F.lit(0), lambda n, w: n + F.size(F.split(w, JOIN)))
    start = parts(F.slice("all_words", 1, F.col("at")))
    own = F.size(F.split(F.col("all_words")[F.col("at")], JOIN))
    return F.filter(F.sequence(start, start + own - 1), lambda k: k < F.col("runs"))


def _of(bench: DataFrame, kind: str, n: int) -> DataFrame:
    return bench.where((F.col("kind") == kind) & (F.col("width") == n))


def _suspects(docs: DataFrame, id_col: str, text_col: str, bench: DataFrame, used: list[tuple[str, int]], few: bool) -> DataFrame:
    """Documents that share a run of any kind with the benchmark, stored; only these get a second look."""
    base = docs.select(F.xxhash64(id_col, text_col).alias("uid"), F.col(text_col).alias("x"))
    hits = []
    for kind, n in used:
        keys = _of(bench, kind, n).select("key").distinct()
        placed = _placed(KINDS[kind](base, "x").select("uid", kind), kind, n)
        hits.append(placed.select("uid", _key(kind, n, any_run=True).alias("key")).join(F.broadcast(keys) if few else keys, "key", "left_semi").select("uid"))
    found = materialize(reduce(DataFrame.unionByName, hits).distinct(), "suspects")
    return F.broadcast(found) if found.count() <= BROADCAST_SUSPECTS else found


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, coverage: float = COVERAGE, id_col: str = "doc_id",
            text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", broadcast_runs: int = BROADCAST_RUNS) -> DataFrame:
    """(uid, doc_id, item_id, coverage, verbatim): ``uid`` is the hash of a document's id and text."""
    bench, used = _benchmark(benchmark, item_id_col, item_text_col, width)
    if not used:
        return docs.limit(0).select(F.lit(0).cast("long").alias("uid"), F.col(id_col).alias("doc_id"), F.lit(0).cast("long").alias("item_id"),
                                    F.lit(0.0).alias("coverage"), F.lit(True).alias("verbatim"))
    few = bench.count() <= broadcast_runs
    suspects = _suspects(docs, id_col, text_col, bench, used, few)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("uid"), F.col(text_col).alias("x"))
    rows = _with_all(rows.join(suspects, "uid", "left_semi"), "x")
    if few:
        bench = F.broadcast(bench)
    slot = lambda k: F.col("item_template")[k].isin(NUMBER, NAME, UNIT)
    pairs = F.transform(
        F.filter(F.sequence(F.lit(0), F.col("width") - 1), slot),
        lambda k: F.struct(F.col("item_words")[k].alias("item"), F.col("run")[k].alias("doc")),
    )
    found = reduce(DataFrame.unionByName, [
        _runs(rows, kind, n).drop("kind").join(_of(bench, kind, n), "key").select(
            "uid", "doc_id", "item_id", "item", "runs", "kind", (F.col("at") - F.col("place")).alias("shift"), "covers", pairs.alias("pairs")
        ) for kind, n in used
    ])
    aligned = found.groupBy("uid", "doc_id", "item_id", "item", "runs", "kind", "shift").agg(
        F.array_distinct(F.flatten(F.collect_set("covers"))).alias("places"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs")
    ).where(F.size(F.array_distinct("pairs.item")) == F.size("pairs"))
    verbatim = F.forall("pairs", lambda p: p["item"] == p["doc"])
    covered = aligned.groupBy("uid", "doc_id", "item_id", "item", "runs").agg(
        F.array_distinct(F.flatten(F.collect_set("places"))).alias("places"), F.bool_and(verbatim).alias("verbatim")
    ).withColumn("coverage", F.size("places") / F.col("runs"))
    return covered.where(F.col("coverage") >= coverage).select("uid", "doc_id", "item_id", "coverage", "verbatim")


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, coverage, verbatim) of every document and item found in it."""
    return matches(docs, benchmark, **options).select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), "verbatim")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that no item contaminates, with their columns as they were."""
    bad = materialize(matches(docs, benchmark, id_col=id_col, text_col=text_col, **options).select("uid").distinct(), "contaminated")
    keyed = wrapped(docs, uid=F.xxhash64(f"`{id_col}`", f"`{text_col}`"))
    return keyed.join(bad, "uid", "left_anti").select("row.*")
