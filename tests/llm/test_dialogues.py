import hashlib
import random
import re
from itertools import product
from zlib import crc32

import pytest

from driftline.llm import dialogues, queries

SCHEMA = "conv_id long, turn int, role string, text string"
SOUND = re.compile("(s?(ua)+)?")
WS = " \t\n\v\f\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def counted(rows):
    """Rows of one conversation in order: counts, and whether each must go or is unfinished."""
    seen, faults, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, _, role, text in rows:
        body = text.strip(WS)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
        if fault:
            n[fault] += 1
    initials = [r[2][:1] for r in rows]
    n["illegal"] = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    turns = {r[1] for r in rows} - {None}
    n["gaps"] = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return n, faults


def all_repairs(rows, faults, inserts=2):
    """Every way to edit the rows, with at most ``inserts`` inserts at one place."""
    ways = [(0, "", ())]
    for row, fault in [*zip(rows, faults), (None, None)]:
        grown = []
        for cost, audit, turns in ways:
            for k in range(inserts + 1):
                for new in product(("user", "assistant"), repeat=k):
                    grown.append((cost + 5 * k, audit + "I" * k, turns + tuple((r, "") for r in new)))
        if row is None:
            ways = grown
            break
        _, _, role, text = row
        ways = []
        for cost, audit, turns in grown:
            ways.append((cost + 2, audit + "D", turns))
            if fault not in ("blank", "duplicate"):
                late = 5 * (fault == "truncated")
                ways.append((cost + late, audit + "K", (*turns, (role, text))))
                ways += [(cost + 1 + late, audit + "R", (*turns, (r, text))) for r in ("user", "assistant")]
    fits = [w for w in ways if SOUND.fullmatch("".join(r[:1] for r, _ in w[2])) and all(r for r, _ in w[2])]
    return min(fits, key=lambda w: w[:2])


def dynamic(rows, faults):
    """Cheapest repair by a table over rows and the last role kept, without any stack."""
    best = {"": (0, "", ())}
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def offer(into, k, v):
        into[k] = min(into.get(k, v), v, key=lambda w: w[:2])

    def inserted(ways):
        for _ in range(4):
            for k, (c, a, t) in list(ways.items()):
                for r in ("user", "assistant"):
                    if (k, r[0]) in after:
                        offer(ways, after[k, r[0]], (c + 5, a + "I", (*t, (r, ""))))
        return ways

    for (_, _, role, text), fault in zip(rows, faults):
        new = {}
        for k, (c, a, t) in inserted(best).items():
            offer(new, k, (c + 2, a + "D", t))
            if fault in ("blank", "duplicate"):
                continue
            late = 5 * (fault == "truncated")
            for r, price, edit in ((role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")):
                if r and (k, r[0]) in after:
                    offer(new, after[k, r[0]], (c + price + late, a + edit, (*t, (r, text))))
        best = new
    return min((w for k, w in inserted(best).items() if k in ("", "a")), key=lambda w: w[:2])


def expected(rows, solve=dynamic):
    groups = {r[0]: [] for r in rows}
    for r in damaged(rows):
        groups[r[0]].append(r)
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0))
        n, faults = counted(own)
        cost, audit, turns = solve(own, faults)
        text = "\n".join(f"{r}:{t}" for r, t in turns)
        out[conv] = (n["gaps"], n["blank"], n["duplicate"], n["truncated"], n["illegal"], cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def found(df, **more):
    rows = dialogues.repair_conversations(dialogues.damage(df), **more).collect()
    out = {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def some_rows(n, length, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "s", "ux", None]
    texts = ["Yes.", "No!", "and then", "x. ", " \n", "", None, "Same?", "über."]
    out = []
    for conv in range(n):
        for turn in sorted(rng.sample(range(-3, 3 * length), rng.randint(1, length))):
            out.append((conv, turn, rng.choices(roles, [9, 9, 3, 1, 1, 1, 1])[0], rng.choice(texts) if rng.random() < 0.6 else f"t{rng.random()}."))
    return out


def test_tables():
    t = dialogues.TABLES
    assert len(t.states) == 6 and len(t.accepts) == 2

    def accepted(word):
        state = 0
        for c in word:
            if (state, c) not in t.shift:
                return False
            state = t.shift[state, c]
        return state in t.accepts

    for n in range(6):
        for word in map("".join, product("sua", repeat=n)):
            assert accepted(word) == bool(SOUND.fullmatch(word)), word


def test_repair_equals_all_edits():
    rng = random.Random(5)
    for _ in range(60):
        rows = [(0, i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b.", "c.", "", "open"])) for i in range(rng.randint(0, 3))]
        _, faults = counted(rows)
        codes = "".join("x" if f in ("blank", "duplicate") else "!" if f and r[2][0] == "t" else r[2][0].upper() if f else r[2][0].replace("t", "?") for r, f in zip(rows, faults))
        cost, audit, _ = dialogues.ending(dialogues.repair(codes, 0))
        want = all_repairs(rows, faults)
        assert (cost, audit) == want[:2] == dynamic(rows, faults)[:2]
        kept = [r[2:] for r, c in zip(rows, codes) if c != "x"]
        assert dialogues.repaired(codes, kept, audit, 0) == [f"{r}:{t}" for r, t in want[2]]


@pytest.mark.parametrize("more", [{}, {"segment_rows": 3}, {"segment_rows": 5, "segment_chars": 9}])
def test_against_slow_version(spark, more):
    rows = some_rows(150, 9, 1) + [(1000, i, *r[2:]) for i, r in enumerate(some_rows(40, 9, 2))]
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "So."), (5000, None, "user", "Why?"), (5000, 7, "assistant", "So.")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # conversations meet partition borders
    try:
        assert found(frame, **more) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_edge_cases(spark):
    schema = SCHEMA + ", conv string, copies double, mark int"
    # one conversation of which every row is dropped, exact repeats of a row, a very long text
    gone = next(i for i in range(1000) if crc32(f"{i}:0".encode()) % 20 == 0)
    free = next(i for i in range(1000) if all(crc32(f"{i}:{t}".encode()) % 20 > 4 for t in (0, 1)))
    rows = [(gone, 0, "user", "Hi."), (free, 0, "user", "w " * 300_000 + "."), (free, 1, "assistant", "So."), (free, 1, "assistant", "So."), (free, 1, "assistant", "So.")]
    frame = spark.createDataFrame([(*r, "x", 0.5, 1) for r in rows], schema)
    got = found(frame)
    assert got == expected(rows)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[free][:7] == (0, 0, 2, 0, 2, 4, "KKDD")
    assert found(frame.limit(0)) == {}
    kept = {r.conv_id: r.audit for r in dialogues.repaired_turns(frame).collect()}
    assert kept == {gone: "D", free: "KKDD"}


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in queries.op13_role_repair(spark, d).collect()}
    assert got == expected(rows)
