import random

import pytest
import regex

from tillcast.llm import decontam
from tillcast.llm.decontam import NAME, NUMBER, UNIT, clean, contaminated, with_template, with_words
from pyspark.sql import functions as F

ITEMS = [
    (0, "A train leaves Boston at 60 km per hour and reaches Denver after 5 hours. How far is Denver from Boston then?"),
    (1, "what is the colour of the sky on a clear day"), (2, "short item"), (3, None), (4, ""), (5, "1 2 3 4 5 6 7 8"),
]
FILL = "some words that come before the passage and have nothing to do with it at all. "
CASES = {
    1: (FILL + ITEMS[0][1] + " " + FILL, (0, True)),
    2: (FILL + "A train leaves London at 75 km per hour and reaches Paris after 9 hours. How far is Paris from London then? " + FILL, (0, False)),
    3: (FILL + "A train leaves London at 75 km per hour and reaches Paris after 9 hours. How far is Rome from Berlin then? " + FILL, None),
    4: ("x " * 3000 + "What is the COLOUR of the sky, on a clear day! " + "y " * 3000, (1, True)),
    5: ("a b short item c d", (2, True)), 6: (None, None), 7: ("", None), 8: (FILL * 20, None),
    9: ("1 2 3 4 5 6 7 8 9", (5, True)), 10: ("9 8 7 6 5 4 3 2 1", None), 11: ("the colour of the sky is what it is on a clear day", None),
}


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, (t, _) in CASES.items()] + [(1, CASES[1][0], 1, 2)], "doc_id long, text string, key int, w int")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("broadcast_runs", [200_000, 0])
def test_cases(tables, broadcast_runs):
    docs, items = tables
    found = {(r.doc_id, r.item_id): r.verbatim for r in contaminated(docs, items, broadcast_runs=broadcast_runs).collect()}
    assert found == {(i, w[0]): w[1] for i, (_, w) in CASES.items() if w}


def test_clean_keeps_the_others_with_their_columns(spark, tables):
    docs, items = tables
    kept = clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, w) in CASES.items() if not w)
    assert clean(docs, items.limit(0)).count() == docs.count() and clean(docs.limit(0), items).count() == 0
    assert contaminated(docs.limit(0), items).count() == contaminated(docs, items.limit(0)).count() == 0


def test_templates_line_up_with_words(spark):
    texts = ["He paid $3.50 to Anna Lee, at 5 km or 10 %.", "Anna ran. Bob ran - 7 miles!", "one of 12th, (4)", "..."]
    for text, want in zip(texts, [["he", "paid", NUMBER, "to", NAME, NAME, "at", NUMBER, UNIT, "or", NUMBER], ["anna", "ran", "bob", "ran", NUMBER, UNIT], [NUMBER, "of", NUMBER, NUMBER], []], strict=True):
        row = with_template(with_words(spark.range(1).select(F.lit(text).alias("x")), "x"), "x").first()
        assert list(row.t) == want and len(row.w) == len(row.t)


def test_plan_has_no_python(tables):
    docs, items = tables
    plan = contaminated(docs, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("change", [str.lower, str.upper, lambda t: t.replace(" Denver", "\nDenver"), lambda t: t.replace(" ", "  ")])
def test_case_and_layout_do_not_hide_a_copy(spark, change):
    docs = spark.createDataFrame([(1, FILL + change(ITEMS[0][1]) + " " + FILL)], "doc_id long, text string")
    found = contaminated(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    assert [tuple(r) for r in found] == [(1, 0, 1.0, True)]


SOLD = "Natalia sold 48 clips in April. Natalia sold half as many clips in May. Natalia then gave five miles of ribbon away. How many clips did Natalia sell in all?"
CHANGED = [
    (0, "A train leaves New York at 75 km per hour and reaches San Diego after 9 hours. How far is San Diego from New York then?", 0),
    (1, SOLD.replace("Natalia", "Weng").replace("48", "52"), 6),
    (2, SOLD.replace("Natalia", "Mary Ann").replace("five miles", "7 km"), 6),
    (3, "Seven pens cost ten dollars and Twenty-two pens cost 30 dollars in the shop", 7),
    (4, "A train leaves New York at 75 km per hour and reaches San Diego after 9 hours. How far is Santa Fe from Las Vegas then?", None),
]


def test_changed_names_and_numbers_anywhere(spark):
    items = [*ITEMS, (6, SOLD), (7, "Three pens cost 4 dollars and 9 pens cost twelve dollars in the shop")]
    docs = spark.createDataFrame([(i, FILL + t + " " + FILL) for i, t, _ in CHANGED], "doc_id long, text string")
    found = contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.verbatim) for r in found} == {(i, w, False) for i, _, w in CHANGED if w is not None}


# --- the whole query again, text by text and without Spark ---

SPACE = r"[ \t\n\x0b\f\r]"
PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def plain_words(text):
    text = "".join(c for c in text.lower() if c not in PUNCT).strip(" \t\n\r\x0b\x0c")
    return regex.split(SPACE + "+", text) if text else []


def plain_template(text):
    text = regex.sub(SPACE + "+", " ", text)
    text = regex.sub(r"\p{Lu}(?<=[^ \t\n\x0b\f\r.!?:] .)\p{Ll}[\p{L}\p{M}'’-]*", decontam.NAME, text)
    text = regex.sub(rf"(?<![\p{{L}}\p{{N}}_])(?:{decontam.NUMBER_WORDS})(?![\p{{L}}\p{{N}}])", decontam.NUMBER, text)
    if regex.search(r"\p{N}", text):
        text = regex.sub(rf"(\p{{N}} )(?i:{decontam.UNITS})(?![\p{{L}}\p{{N}}])", rf"\1{decontam.UNIT}", text)
        text = regex.sub(r"(?<![^ \t\n\x0b\f\r])[-+$€£(\[\"']{0,3}\p{N}[^ \t\n\x0b\f\r]*", decontam.NUMBER, text)
    return plain_words(text)


def plain_joined(text):
    text = regex.sub(SPACE + "+", " ", text)
    named = rf"(?!(?i:{decontam.NUMBER_WORDS})(?![\p{{L}}\p{{N}}]))\p{{Lu}}\p{{Ll}}"
    return regex.sub(rf"(?<![^ \p{{Ps}}\p{{Pi}}\"'])({named}[\p{{L}}\p{{M}}'’-]*) (?={named})", rf"\1{decontam.JOIN}", text)


def plain_names(joined):
    n = decontam.NUMBER_WORDS
    text = regex.sub(rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:{n})(?:-(?:{n}))*(?![\p{{L}}\p{{N}}])", decontam.NUMBER, joined)
    text = regex.sub(rf"(?<![^ \p{{Ps}}\p{{Pi}}\"'])\p{{Lu}}\p{{Ll}}[\p{{L}}\p{{M}}'’{decontam.JOIN}-]*", decontam.NAME, text)
    text = regex.sub(rf"([\p{{N}}{decontam.NUMBER}] )(?i:{decontam.UNITS})(?![\p{{L}}\p{{N}}])", rf"\1{decontam.UNIT}", text)
    return plain_words(regex.sub(r"(?<![^ ])[-+$€£(\[\"']{0,3}\p{N}[^ ]*", decontam.NUMBER, text))


def views(text):
    """(kind, template, words, first word of each place in the words as they are) of a text."""
    words, joined = plain_words(text), plain_joined(text)
    names = plain_words(joined)
    starts = [0]
    for w in names:
        starts.append(starts[-1] + len(w.split(decontam.JOIN)))
    plain = list(range(len(words) + 1))
    return [("w", words, words, plain), ("t", plain_template(text), words, plain), ("f", plain_names(joined), names, starts)]


def brute_force(docs, items, width=decontam.WIDTH, least=decontam.COVERAGE):
    marks = {decontam.NUMBER, decontam.NAME, decontam.UNIT}
    out = []
    for item_id, item in sorted({(i, t or "") for i, t in items}):
        words = plain_words(item)
        if not words:
            continue
        runs = len(words) - min(len(words), width) + 1
        for doc_id, doc in docs:
            covered, verbatim = set(), True
            for (kind, t, w, starts), (_, dt, dw, _) in zip(views(item), views(doc or "")):
                n = min(len(t), width)
                shifts = {}
                for a in range(len(t) - n + 1) if n else []:
                    run = t[a : a + n]
                    if kind != "w" and sum(x in marks for x in run) > n - 2:
                        continue
                    for b in range(len(dt) - n + 1):
                        if dt[b : b + n] == run:
                            places, pairs = shifts.setdefault(b - a, (set(), set()))
                            places |= {p for p in range(starts[a], starts[a + 1]) if p < runs}
                            pairs |= {(w[a + k], dw[b + k]) for k in range(n) if run[k] in marks}
                for places, pairs in shifts.values():
                    if len({x for x, _ in pairs}) == len(pairs):
                        covered |= places
                        verbatim &= all(x == y for x, y in pairs)
            if len(covered) / runs >= least:
                out.append((doc_id, item_id, round(len(covered) / runs, 6), verbatim))
    return sorted(out)


def test_whole_query_against_plain_python(spark):
    draw = random.Random(12)
    bank = ["Natalia sold 48 clips to her friends in April, then half as many in May.", "A train leaves Denver at 9:30 and goes 60 miles per hour to Salt Lake City.",
            "Weng earns twelve dollars an hour for babysitting. Yesterday she did 50 minutes.", "El tren sale de Madrid a las 9 y llega a Sevilla en 3 horas.", "Der Zug fährt 80 km von Berlin nach Köln.", "short item", "one two", "?!", None]
    swaps = [("Natalia", "Maria"), ("48", "52"), ("April", "June"), ("Denver", "New York"), ("60", "75"), ("miles", "km"), ("twelve", "ninety-two"), ("Weng", "Li"), ("Madrid", "Lisboa"), ("80", "95"), ("Berlin", "Bonn"), ("half", "twice")]
    docs = []
    for i in range(60):
        text = draw.choice(bank[:7])
        for a, b in draw.sample(swaps, draw.randint(0, 5)):
            text = text.replace(a, b)
        if draw.random() < 0.3:
            text = draw.choice([str.upper, str.lower, lambda t: t.replace(" ", "\n  ")])(text)
        if draw.random() < 0.3:
            cut = draw.randint(0, len(text))
            text = text[:cut] + " Some Other words, " + text[cut:]
        docs.append((i, draw.choice(["", "Before it. ", "lead "]) + text + draw.choice(["", " And after 3 days."])))
    docs += [(100, None), (101, ""), (102, "one two one two"), (103, "Zürich 5 kg")]
    items = [(i, t) for i, t in enumerate(bank)]
    found = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = sorted((r.doc_id, r.item_id, r.coverage, r.verbatim) for r in found.collect())
    want = brute_force(docs, items)
    assert rows == want and len(want) > 25 and len({v for *_, v in want}) == 2


def test_patterns_fail_at_their_first_character(spark):
    frame = spark.createDataFrame([("x",)], "x string")
    for kind in ("t", "f"):
        plan = decontam.KINDS[kind](frame, "x").select(kind)._jdf.queryExecution().optimizedPlan().toString()
        # what looks behind a place, or at both sides of it, comes after what most places fail at
        assert "regexp_replace" in plan and not regex.search(r", (\(\?i\))?(\(\?<|\\b)", plan), plan
