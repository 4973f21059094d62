"""Language identification by Bayesian fusion of several kinds of evidence.

* Text: byte trigrams of the lower-case letters, hashed into a table of fixed size, with add-one
  smoothing. Neighbouring trigrams overlap and long texts repeat themselves, so the sum counts
  as that of ``EFFECTIVE`` trigrams at most. A uniform model stands for all other languages.
* The language declared in the markup, and the language marker of the address: how often each
  value goes with each language is counted over all rows.
* The host: counts of the languages of a host's rows by text, smoothed towards its domain, that
  towards the address suffix, and that towards all rows. The row itself is left out. The
  counts are grouped aggregates; a hot host is combined before the shuffle, and the join that
  brings the prior to the rows carries no texts.

The text model is fitted on a bounded sample of labelled rows: ``SAMPLE`` different texts of each
language, those with the smallest hash. All else is counted over all rows.

Null and empty texts have no text evidence, and a row is accepted only if its own text
supports the language. Null hosts, declared values and markers give no evidence. Rows that repeat
are judged each. Ties go to the language named first. An empty table gives no rows; without
labelled rows every language is equally likely.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tillcast.llm.common import chunks, forget, give_back, text_chunks
from tillcast.session import materialize

LANGUAGES = ("en", "de", "fr", "es")
OTHER = "und"
#: Different texts of each language that the text model is fitted on.
SAMPLE = 500
BUCKETS = 1 << 15
EFFECTIVE = 60
#: Rows that a level's smoothing towards the next level counts as.
WEIGHT = 20.0
OTHER_PRIOR = 0.01
#: A declared value or marker is wrong at least this often.
WRONG = 0.02

_LETTERS = bytes(
    b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def trigrams(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of all texts, and the text of each; runs of other bytes are one blank."""
    parts = [b" ".join((t or "").lower().encode("utf-8", "replace").translate(_LETTERS).split()) for t in texts]
    raw = np.frombuffer(b" " + b"  ".join(parts) + b" ", np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(parts)), [len(p) + 2 for p in parts])
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    bucket = (code * np.uint32(2654435761)) >> np.uint32(17)
    inside = (owner[:-2] == owner[2:]) & (raw[1:-1] != 32)
    return bucket[inside].astype(np.int64), owner[:-2][inside]


@dataclass
class TextModel:
    languages: tuple[str, ...]
    table: np.ndarray  # log probabilities by bucket and language, the uniform model last

    def evidence(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods by text and language, and the number of trigrams."""
        out = np.zeros((len(texts), self.table.shape[1]))
        n = np.zeros(len(texts), np.int64)
        for a, b in chunks(texts):
            bucket, owner = trigrams(texts[a:b])
            n[a:b] = np.bincount(owner, minlength=b - a)
            for k in range(self.table.shape[1]):
                out[a:b, k] = np.bincount(owner, weights=self.table[bucket, k], minlength=b - a)
        out *= (np.minimum(n, EFFECTIVE) / np.maximum(n, 1))[:, None]
        return out, n


def fit(labelled: DataFrame, languages: Sequence[str] = LANGUAGES, text_col: str = "text",
        label_col: str = "lang", sample: int = SAMPLE) -> TextModel:
    """Fit the text model on the bounded sample of ``labelled``."""
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"))
    rows = rows.where(F.col("label").isin(*languages) & F.col("text").isNotNull())
    keyed = rows.withColumn("key", F.xxhash64("text"))
    order = Window.partitionBy("label").orderBy("key")
    chosen = keyed.select("label", "key").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample)
    texts = keyed.join(F.broadcast(chosen.drop("n")), ["label", "key"]).dropDuplicates(["label", "key"]).select("label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            text, label = batch.column("text").to_pylist(), batch.column("label").to_pylist()
            for a, b in chunks(text):
                bucket, owner = trigrams(text[a:b])
                for name in set(label[a:b]):
                    mine = np.array([x == name for x in label[a:b]])
                    seen.setdefault(name, np.zeros(BUCKETS, np.int64))
                    seen[name] += np.bincount(bucket[mine[owner]], minlength=BUCKETS)
        for name, counts in seen.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())],
                ["label", "bucket", "n"],
            )

    counted = texts.mapInArrow(count, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    table = np.ones((BUCKETS, len(languages) + 1))
    for row in counted.toLocalIterator():  # at most buckets x languages rows
        table[row["bucket"], languages.index(row["label"])] += row["n"]
    table[:, -1] = 1.0
    return TextModel(tuple(languages), np.log(table / table.sum(0)))


#: Columns of the evidence in a row: hidden names, so that a table's own columns stay apart.
_LL, _N, _BEST = "__likelihood", "__trigrams", "__best"


def with_text_evidence(rows: DataFrame, model: TextModel, text_col: str) -> DataFrame:
    """Every row and its columns but for the text, with the text's log likelihoods and best language.

    Rows come back in batches of bounded text, as neither side has room for many large ones at once.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kept = [i for i, field in enumerate(rows.schema.fields) if field.name != text_col]
    schema = StructType([*(rows.schema.fields[i] for i in kept), StructField(_LL, ArrayType(DoubleType())), StructField(_N, LongType()), StructField(_BEST, LongType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for a, b, text in text_chunks(batch.column(text_col)):
                ll, n = shared.value.evidence(text)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in kept),
                     pa.array(ll.tolist(), pa.list_(pa.float64())), pa.array(n), pa.array(ll.argmax(1), pa.int64())],
                    [*(batch.schema.names[i] for i in kept), _LL, _N, _BEST],
                )
        give_back()

    return rows.mapInArrow(score, schema)


def host_of(url: Column) -> tuple[Column, Column, Column]:
    """(host, domain, suffix) of an address."""
    host = F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)", 1))
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    suffix = F.regexp_extract(host, r"([^.]+)$", 1)
    blank = lambda c: F.when(c != "", c)
    return blank(host), blank(domain), blank(suffix)


def marker_of(url: Column) -> Column:
    """A two-letter first path segment, the usual place of an address's language."""
    found = F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:[/?#]|$)", 1))
    return F.when(found != "", found)


def declared_of(html: Column) -> Column:
    found = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2})", 1))
    return F.when(found != "", found)


def visible(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w{1,8};", " ")


def _confusion(evidence: DataFrame, column: str, languages: Sequence[str]) -> dict[str, list[float]]:
    """log P(value | language), counted over all rows whose text speaks for a language."""
    known = F.when(F.col(column).isin(*languages), F.col(column)).otherwise("other")
    counts = evidence.where(F.col(column).isNotNull() & (F.col(_BEST) < len(languages)) & (F.col(_N) > 0)).groupBy(
        known.alias("value"), _BEST
    ).count().collect()  # values x languages rows at most
    names = [*languages, "other"]
    table = np.ones((len(names), len(languages)))
    for row in counts:
        table[names.index(row["value"]), row[_BEST]] += row["count"]
    share = table / table.sum(0)
    share = (1 - WRONG * len(names)) * share + WRONG
    # the other languages may go with any value
    return {name: [*np.log(share[i]).tolist(), math.log(1 / len(names))] for i, name in enumerate(names)}


def _priors(evidence: DataFrame, languages: int) -> DataFrame:
    """(host, domain, suffix) with the counts of every level; one row a host."""
    by = ["__host", "__domain", "__suffix"]
    counted = evidence.where((F.col(_BEST) < languages) & (F.col(_N) > 0) & F.col("__host").isNotNull())
    hosts = counted.groupBy(*by).pivot(_BEST, list(range(languages))).count()
    hosts = materialize(hosts.select(*by, *(F.coalesce(F.col(str(k)), F.lit(0)).alias(f"__h{k}") for k in range(languages))), "hosts")

    def level(key: str, name: str) -> DataFrame:
        return hosts.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"{key}_")).agg(
            *(F.sum(f"__h{k}").alias(f"__{name}{k}") for k in range(languages))
        )

    total = hosts.agg(*(F.coalesce(F.sum(f"__h{k}"), F.lit(0)) for k in range(languages))).first()
    out = hosts
    for key, name in (("__domain", "d"), ("__suffix", "s")):
        up = level(key, name)
        out = out.join(up, F.col(key) == F.col(f"{key}_"), "left").drop(f"{key}_")
    zeros = [F.coalesce(F.col(c), F.lit(0)).alias(c) if c[:3] in ("__d", "__s") and c[3:].isdigit() else F.col(c) for c in out.columns]
    out = out.select(*zeros, *(F.lit(n).alias(f"__g{k}") for k, n in enumerate(total)))
    return out.drop("__domain", "__suffix")


@dataclass
class Evidence:
    """Columns of a table that carry evidence; each may be absent."""

    text: str = "text"
    declared: str | None = None
    marker: str | None = None
    host: str | None = None
    domain: str | None = None
    suffix: str | None = None


def identify(rows: DataFrame, model: TextModel, columns: Evidence, least: float = 0.5) -> DataFrame:
    """Add (language, posterior, accepted) to rows; all other columns stay as they are."""
    languages, own = model.languages, rows.columns
    size = len(languages)
    pick = lambda name: F.lower(F.col(name).cast("string")) if name else F.lit(None).cast("string")
    hidden = {
        "__text": F.col(columns.text).cast("string"), "__declared": F.substring(pick(columns.declared), 1, 2),
        "__marker": pick(columns.marker), "__host": pick(columns.host), "__domain": pick(columns.domain), "__suffix": pick(columns.suffix),
    }
    dressed = rows.select(*(F.col(f"`{c}`") for c in own), *(c.alias(n) for n, c in hidden.items()))
    facts = dressed.select(*hidden)
    evidence = materialize(with_text_evidence(facts, model, "__text"), "evidence")
    declared, marker = (_confusion(evidence, c, languages) for c in ("__declared", "__marker"))
    priors = _priors(evidence, size).withColumnRenamed("__host", "__h")
    scored = with_text_evidence(dressed, model, "__text")
    joined = scored.join(priors, F.col("__host") == F.col("__h"), "left").drop("__h")

    def table(name: str, values: dict[str, list[float]], k: int) -> Column:
        column = F.when(F.col(name).isNull(), 0.0)
        for value, logs in values.items():
            if value != "other":
                column = column.when(F.col(name) == value, logs[k])
        return column.otherwise(values["other"][k])

    def mine(k: int) -> Column:  # the row's own count, which is left out at every level
        return ((F.col(_BEST) == k) & F.col("__h0").isNotNull() & (F.col(_N) > 0)).cast("double")

    def smoothed(level: str, k: int, towards: Column) -> Column:
        n = lambda j: F.greatest(F.coalesce(F.col(f"__{level}{j}").cast("double"), F.lit(0.0)) - mine(j), F.lit(0.0))
        total = sum((n(j) for j in range(size)), F.lit(0.0))
        return (n(k) + WEIGHT * towards) / (total + WEIGHT)

    logs = []
    for k in range(size):
        prior = F.lit(1 / size)
        for level in ("g", "s", "d", "h"):
            prior = smoothed(level, k, prior)
        logs.append(F.col(_LL)[k] + table("__declared", declared, k) + table("__marker", marker, k) + F.log(prior * (1 - OTHER_PRIOR)))
    logs.append(F.col(_LL)[size] + table("__declared", declared, size) + table("__marker", marker, size) + math.log(OTHER_PRIOR))
    joined = joined.withColumn("__logs", F.array(*logs))
    top = F.array_max("__logs")
    posterior = F.lit(1.0) / F.aggregate("__logs", F.lit(0.0), lambda s, x: s + F.exp(x - top))
    names = F.array(*(F.lit(x) for x in (*languages, OTHER)))
    best = F.array_position("__logs", top).cast("int")
    # the text itself must speak for the language rather than for none
    supported = (F.col(_N) > 0) & (F.element_at(F.col(_LL), best) >= F.col(_LL)[size])
    verdict = joined.select(*(F.col(f"`{c}`") for c in own if c not in ("language", "posterior", "accepted")),
                            F.element_at(names, best).alias("language"), F.round(posterior, 6).alias("posterior"), supported.alias("__ok"))
    return verdict.withColumn("accepted", (F.col("language") != OTHER) & F.col("__ok") & (F.col("posterior") >= least)).drop("__ok")


def accepted_rows(docs: DataFrame, model: TextModel, columns: Evidence, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is accepted, with their columns as they were."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    inside = Evidence(**{name: c and f"row.`{c}`" for name, c in asdict(columns).items()})  # no text goes along twice
    kept = identify(rows, model, inside, least).where("accepted")
    return kept.select("row.*")
