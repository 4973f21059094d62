import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillcast.llm import langid
from tillcast.llm.langid import Evidence, accepted_rows, fit, identify, trigrams

DATA = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def model(spark):
    return fit(spark.read.parquet(DATA).where("doc_id % 2 = 0"))


def test_held_out_accuracy_by_text_alone(spark, model):
    rows = spark.read.parquet(DATA).where("doc_id % 2 = 1").collect()
    ll, _ = model.evidence([r.text for r in rows])
    best = [(*model.languages, "und")[k] for k in ll.argmax(1)]
    assert np.mean([a == r.lang for a, r in zip(best, rows, strict=True)]) > 0.97


def test_trigrams_against_a_plain_count():
    texts = ["Ab  c!d", None, "", "é", "... 12", "the the"]
    bucket, owner = trigrams(texts)

    def plain(text):
        raw = b" " + b" ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).encode().split()) + b" "
        return [((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % 2**32) >> 17 for i in range(len(raw) - 2) if raw[i + 1] != 32]

    for i, text in enumerate(texts):
        assert bucket[owner == i].tolist() == plain(text)


def test_sources_of_evidence(spark, model):
    english = "the and of that with for from this was is are there other the of and to in a"
    rows = [(i, english, "en", "a.org", "a.org", "org") for i in range(40)]
    rows += [(100, "de la en", None, "fr.net", "fr.net", "net"), (101, "de la en", None, "es.net", "es.net", "net")]
    rows += [(200 + i, "le des une avec dans pour que est les du qui sur", "fr", "fr.net", "fr.net", "net") for i in range(30)]
    rows += [(300 + i, "los las una con por para que es del se como ción", "es", "es.net", "es.net", "net") for i in range(30)]
    rows += [(400, None, "en", "a.org", "a.org", "org"), (401, "", None, None, None, None), (402, "*** 123 |||", "de", None, None, None), (403, "ツツツ кот море дом", None, "a.org", "a.org", "org")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, domain string, suffix string")
    found = {r.doc_id: r for r in identify(frame, model, Evidence("text", "declared", None, "host", "domain", "suffix")).collect()}
    assert all(found[i].language == "en" and found[i].accepted for i in range(40))
    # a French host makes a short, mixed text more certainly French than a Spanish host does
    assert found[100].language == "fr"
    assert found[101].language == "es" or found[101].posterior < found[100].posterior
    assert not any(found[i].accepted for i in (400, 401, 402, 403))
    assert all(0 <= r.posterior <= 1 for r in found.values())


def test_rows_come_back_as_they_were(spark, model):
    docs = spark.read.parquet(DATA).withColumns({"language": F.lit("x"), "posterior": F.lit(1), "row": F.lit("r"), "__h": F.lit(2)})
    kept = accepted_rows(docs, model, Evidence("text", declared="lang", host="source"))
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() and kept.exceptAll(docs).count() == 0
    assert accepted_rows(docs.limit(0), model, Evidence("text", host="source")).count() == 0
    assert fit(docs.limit(0)).evidence(["abc"])[0].shape == (1, 5)


def test_addresses_and_markup(spark):
    row = spark.range(1).select(
        F.struct(*langid.host_of(F.lit("http://u:p@Blog.Ab.example.NET:80/fr/1?x"))).alias("h"),
        langid.marker_of(F.lit("http://a.org/fr/1")).alias("m"), langid.marker_of(F.lit("http://a.org/fra/1")).alias("n"),
        langid.declared_of(F.lit("<!DOCTYPE html><HTML class=x LANG='de-AT'>")).alias("d"),
        langid.visible(F.lit("<p>a<script>var t='</p>';</script>b&amp;c<!-- x -->")).alias("v"),
    ).first()
    assert tuple(row.h) == ("blog.ab.example.net", "example.net", "net")
    assert (row.m, row.n, row.d) == ("fr", None, "de") and row.v.split() == ["a", "b", "c"]


def brute_force(rows, model, least=0.5):
    """The fused verdict of every row (id, text, declared, marker, host, domain, suffix), in plain Python."""
    names, size = model.languages, len(model.languages)
    ll, n = model.evidence([r[1] for r in rows])
    best = [int(np.argmax(x)) for x in ll]
    counts = [b < size and k > 0 for b, k in zip(best, n)]  # rows whose text speaks for a language

    def confusion(column):
        known = [*names, "other"]
        table = {v: [1.0] * size for v in known}
        for r, b, ok in zip(rows, best, counts):
            if r[column] is not None and ok:
                table[r[column] if r[column] in names else "other"][b] += 1
        sums = [sum(table[v][k] for v in known) for k in range(size)]
        wrong = langid.WRONG
        return {v: [math.log((1 - wrong * len(known)) * table[v][k] / sums[k] + wrong) for k in range(size)] + [math.log(1 / len(known))] for v in known}

    tables = {2: confusion(2), 3: confusion(3)}
    # a host's domain and suffix count for all rows of the host that have them
    levels = {"g": lambda r: "all", "s": lambda r: r[6], "d": lambda r: r[5], "h": lambda r: r[4]}
    held = {name: {} for name in levels}
    for r, b, ok in zip(rows, best, counts):
        if ok and r[4] is not None:
            for name, key in levels.items():
                if key(r) is not None:
                    held[name].setdefault(key(r), [0] * size)[b] += 1
    out = {}
    for r, own, b, k, ok in zip(rows, ll, best, n, counts):
        counted_host = r[4] is not None and r[4] in held["h"]
        logs = []
        for lang in range(size + 1):
            log = own[lang] + sum(tables[c][r[c] if r[c] in names else "other"][lang] for c in (2, 3) if r[c] is not None)
            if lang == size:
                logs.append(log + math.log(langid.OTHER_PRIOR))
                continue
            prior = 1 / size
            for name, key in levels.items():
                seen = held[name].get(key(r), [0] * size) if counted_host else [0] * size
                seen = [max(c - (ok and counted_host and b == j), 0) for j, c in enumerate(seen)]
                prior = (seen[lang] + langid.WEIGHT * prior) / (sum(seen) + langid.WEIGHT)
            logs.append(log + math.log(prior * (1 - langid.OTHER_PRIOR)))
        top = max(logs)
        chosen = logs.index(top)
        posterior = 1 / sum(math.exp(x - top) for x in logs)
        language = [*names, "und"][chosen]
        out[r[0]] = (language, posterior, chosen < size and k > 0 and own[chosen] >= own[size] and round(posterior, 6) >= least)
    return out


def test_fused_posterior_against_plain_python(spark, model):
    draw = random.Random(7)
    words = {"en": "the and of that with for from this", "de": "der die und das mit von für nicht", "fr": "le des une avec dans pour que est", "es": "los las una con por para que es"}
    hosts = [(f"h{i}.{d}", d, d.split(".")[1]) for i, d in enumerate(["a.org", "a.org", "b.fr", "c.es", "d.de", "d.de"])] + [(None, None, None), ("h9.a.org", "a.org", "org")]
    rows = []
    for i in range(400):
        host = hosts[0] if draw.random() < 0.3 else draw.choice(hosts)
        lang = draw.choice([*words])
        text = draw.choice([None, "", "12 ** 3", "кот море", *[" ".join(draw.choices(words[lang].split() + words[draw.choice([*words])].split()[:2], k=draw.randint(1, 9))) for _ in range(6)]])
        rows.append((i, text, draw.choice([None, lang, lang, "it"]), draw.choice([None, None, lang, "en"]), *host))
    frame = spark.createDataFrame(rows, "doc_id long, text string, declared string, marker string, host string, domain string, suffix string")
    found = {r.doc_id: r for r in identify(frame, model, Evidence("text", "declared", "marker", "host", "domain", "suffix")).collect()}
    want = brute_force(rows, model)
    assert len(found) == len(rows) and len({w[0] for w in want.values()}) > 3
    for i, (language, posterior, accepted) in want.items():
        assert found[i].posterior == pytest.approx(posterior, abs=2e-6), i
        assert (found[i].language, found[i].accepted) == (language, accepted), i


def test_a_text_does_not_come_back_from_scoring(spark):
    docs = spark.createDataFrame([(i, f"the cat and the dog {i}", "en", "a.org") for i in range(2500)], "doc_id long, text string, lang string, source string").coalesce(1)
    model = langid.fit(docs)
    scored = langid.with_text_evidence(docs, model, "text")
    assert "text" not in scored.columns
    rows = scored.orderBy("doc_id").collect()
    want, _ = model.evidence([f"the cat and the dog {i}" for i in range(2500)])
    assert [r.doc_id for r in rows] == list(range(2500)) and [list(r["__likelihood"]) for r in rows] == want.tolist()
    assert langid.accepted_rows(docs, model, langid.Evidence("text", declared="lang", host="source")).columns == docs.columns
