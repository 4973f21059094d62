import hashlib
import itertools
import random
import re
import zlib

import pytest

from tillcast.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        plain = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{plain(conv)}:{plain(turn)}".encode()) % 20
        role, text = plain(role), plain(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept = out.setdefault(conv, [])
        kept += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(BLANKS)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        out.append(fault)
    return out


def cheapest(rows, found):
    """All audits with up to two insertions in a place, tried one by one."""
    best = None
    gaps = ["", "u", "a", "ua", "au"]
    choices = []
    for (_, role, text), fault in zip(rows, found):
        late = 3 if fault == "truncated" else 0
        own = [("D", 4, None)]
        if fault not in ("blank", "duplicate"):
            own += [("K", late, (role, text)), ("R", 3 + late, ("user", text)), ("R", 3 + late, ("assistant", text))]
        choices.append([(gap, *o) for gap in gaps for o in own])
    names = {"u": "user", "a": "assistant"}
    for plan in itertools.product(*choices, [(gap, "", 0, None) for gap in gaps]):
        turns, cost, audit = [], 0, ""
        for gap, letter, price, turn in plan:
            turns += [(names[g], "") for g in gap] + ([turn] if turn else [])
            cost, audit = cost + 3 * len(gap) + price, audit + "I" * len(gap) + letter
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] if r[:1] in ("s", "u", "a") else "o" for r, _ in turns)):
            best = min(best or (cost, audit, turns), (cost, audit, turns))
    return best


def expected(rows):
    out = {}
    for conv, kept in damage(rows).items():
        found = faults(kept)
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, fixed = cheapest(kept, found)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out[conv] = (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def small_rows():
    draw = random.Random(8)
    rows = []
    for conv in [*range(50), None]:
        for turn in range(draw.randint(1, 3)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "é"])
            text = draw.choice([None, "", " \n", "\x85", " ", "Yes.", "Yes.", "No", "Why? \n", "a.b", "é!", "..."])
            rows.append((conv, draw.choice([turn, turn, turn + 1, None]), role, text))
    return rows


def run(spark, rows, **sizes):
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as place", "2 as block", "3 as conv", "4 as cost")
    return {r[0]: tuple(r[1:]) for r in repair.damage_and_repair(frame, **sizes).collect()}


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 1, "rounds": 0}])
def test_against_all_edits(spark, monkeypatch, sizes):
    monkeypatch.setattr(repair, "FAN_IN", 2)
    rows = small_rows()
    assert run(spark, rows, **sizes) == expected(rows)


def plain(seq):
    """The best audit of symbols, by one pass over the states; shares no code with the operator."""
    moves = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    held = {0: (0, "")}

    def relax(states):
        for _ in range(2):
            for i, (cost, audit) in list(states.items()):
                for c, j in moves[i].items():
                    if c != "s":
                        states[j] = min(states.get(j, (10**9, "")), (cost + 3, audit + "I"))
        return states

    for symbol in seq:
        after, late = {}, 3 if symbol.isupper() else 0
        for i, (cost, audit) in relax(held).items():
            options = [(i, 4, "D")]
            if symbol != "x":
                options += [(j, 3 + late, "R") for c, j in moves[i].items() if c != "s"]
                options += [(j, late, "K") for c, j in moves[i].items() if c == symbol.lower()]
            for j, price, letter in options:
                after[j] = min(after.get(j, (10**9, "")), (cost + price, audit + letter))
        held = after
    return min(relax(held)[i] for i in (0, 3) if i in held)


def test_rules_give_what_single_symbols_give(spark):
    draw = random.Random(2)
    seqs = {"".join(draw.choices("uaUAsox", weights=[6, 6, 2, 2, 1, 1, 2], k=draw.randint(1, 60))) for _ in range(80)} | {"ua" * 40, "u" * 33}
    packed, rules = repair.repair_pairs(spark.createDataFrame([(s,) for s in seqs], "seq string"))
    spelled = {}
    for rule, (left, right) in rules.items():
        spelled[rule] = spelled.get(left, left) + spelled.get(right, right)
    rows = packed.collect()
    assert all("".join(spelled.get(c, c) for c in r.packed) == r.seq for r in rows)
    assert sum(len(r.packed) for r in rows) < 0.6 * sum(map(len, seqs))
    best = repair._exit(repair.F.col("costs"), repair.F.col("audits"))
    found = {r.seq: (r.best.cost, r.best.audit) for r in repair.evaluated(packed, rules).withColumn("best", best).collect()}
    assert found == {s: plain(s) for s in seqs}


def test_a_long_conversation_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(repair, "FAN_IN", 3)
    draw = random.Random(5)
    rows = [(1, t, draw.choice(["user", "assistant", "assistant", "tool"]), f"{t}{draw.choice('. .!')}") for t in range(400)]
    rows += [(2, 0, "user", "w " * 50_000 + "."), (2, 1, "assistant", "done.")]
    gone = next(c for c in range(3, 500) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "Hi."))
    found = run(spark, rows, block_rows=16)
    assert found[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    kept = damage(rows)
    for conv in (1, 2):
        symbols = ""
        for (_, role, _), fault in zip(kept[conv], faults(kept[conv])):
            base = role[0] if role[0] in "sua" else "o"
            symbols += "x" if fault in ("blank", "duplicate") else base.upper() if fault else base
        assert found[conv][5:7] == plain(symbols)
    whole = run(spark, rows)
    assert whole == found
    assert run(spark, [], block_rows=4) == {}
