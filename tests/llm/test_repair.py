"""Repair of conversations against plain versions: every possible edit on short sequences, a plain search on whole tables."""
import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridsight.llm import repair
from gridsight.llm.queries import load

PATTERN = re.compile("(s?(ua)+)?")
WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, copy string, digest string, conv string, rows string, kind string, audit string"


def by_every_edit(sequence):
    """All edits with up to two insertions in each gap."""
    rows = []
    for c in sequence:
        late = 5 if c.isupper() else 0
        kept = [] if c == "x" else [(late, "K", c.lower()), (1 + late, "R", "u"), (1 + late, "R", "a")]
        rows.append([(2, "D", ""), *kept])
    gap = [(5 * n, "I" * n, "".join(w)) for n in range(3) for w in itertools.product("ua", repeat=n)]
    best = None
    for chosen in itertools.product(gap, *itertools.chain.from_iterable((r, gap) for r in rows)):
        if PATTERN.fullmatch("".join(c[2] for c in chosen)):
            here = (sum(c[0] for c in chosen), "".join(c[1] for c in chosen))
            best = here if best is None else min(best, here)
    return best


def by_search(sequence):
    """The best (cost, audit) to each state after each row, whole texts compared."""
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    def insert(states):
        for _ in range(4):
            for p, (cost, audit) in list(states.items()):
                for c, q in step[p].items():
                    if c != "s":
                        states[q] = min(states.get(q, (10 ** 9, "")), (cost + 5, audit + "I"))
        return states

    states = insert({0: (0, "")})
    for c in sequence:
        late, after = 5 if c.isupper() else 0, {}
        for p, (cost, audit) in states.items():
            moves = [(p, 2, "D")]
            if c != "x":
                moves += [(q, 1 + late, "R") for r, q in step[p].items() if r != "s"] + [(q, late, "K") for r, q in step[p].items() if r == c.lower()]
            for q, more, edit in moves:
                after[q] = min(after.get(q, (10 ** 9, "")), (cost + more, audit + edit))
        states = insert(after)
    return min(states[q] for q in (0, 3) if q in states)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="suaoSUAOx", max_size=3))
def test_plain_search_equals_every_edit(sequence):
    assert by_search(sequence) == by_every_edit(sequence)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="suaoSUAOx", max_size=40), min_size=1, max_size=12))
def test_grammar_equals_plain_search(sequences):
    assert repair.solve([s.encode() for s in sequences]) == [by_search(s) for s in sequences]


def test_rules_are_shared_and_spell_the_sequences():
    rng = random.Random(7)
    sequences = [("s" if rng.random() < 0.2 else "") + "ua" * rng.randrange(1, 200) + rng.choice(["", "U", "xua"]) for _ in range(50)] + ["", "u" * 33]
    rules, short = repair.re_pair([s.encode() for s in sequences])

    def spell(x):
        return chr(repair.SYMBOLS[x]) if x < 9 else spell(rules[x - 9][0]) + spell(rules[x - 9][1])

    assert ["".join(map(spell, s.tolist())) for s in short] == sequences
    assert len(rules) < 60 and sum(map(len, short)) < 0.1 * sum(map(len, sequences))
    few, _ = repair.re_pair([s.encode() for s in sequences], most_rules=3)
    assert len(few) == 3 and repair.solve([s.encode() for s in sequences], 3) == repair.solve([s.encode() for s in sequences])


def test_a_long_sequence_of_ties():
    rng = random.Random(1)
    long = "".join(rng.choice("uaoUAx") for _ in range(3000))
    assert repair.solve([long.encode()]) == [by_search(long)]


@given(st.lists(st.text(alphabet="DIKR", max_size=5), min_size=2, max_size=8))
def test_ropes_compare_as_texts(parts):
    def build(some):
        return some[0] if len(some) == 1 else repair.Rope(build(some[:len(some) // 2]), build(some[len(some) // 2:]))

    a, b = build(parts), build(parts[::-1])
    assert str(a) == "".join(parts) and repair.less(a, b) == (str(a) < str(b)) and repair.less(b, a) == (str(b) < str(a)) and not repair.less(a, a)


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows, ids):
    out = {}
    for conv in ids:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        seen, sequence, faults = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in mine:
            body = text.strip(WHITE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            c = role[:1] if role[:1] in ("s", "u", "a") else "o"
            sequence += "x" if fault in ("blank", "duplicate") else c.upper() if fault else c
        turns = {r[1] for r in mine if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit = by_search(sequence)
        lines, at, state = [], iter(mine), ""
        for edit in audit:
            following = "a" if state.endswith("u") else "u"
            name = {"u": "user", "a": "assistant"}[following]
            if edit == "I":
                lines.append(f"{name}:")
            else:
                _, _, role, text = next(at)
                if edit == "D":
                    continue
                following, name = (role[:1], role) if edit == "K" else (following, name)
                lines.append(f"{name}:{text}")
            state += following
        assert PATTERN.fullmatch(state)
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_the_plain_version(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: (*[r[c] for c in COLUMNS], r["repaired_sha256"]) for r in load()[0]["op13_conversation_repair"](spark, folder).collect()}
    assert got == plain_repair(plain_damage(rows), {r[0] for r in rows})


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["own"] * 6) for r in rows], SCHEMA)


def answers(df):
    return {r["conv"]: (*[r[c] for c in COLUMNS], r["sha"]) for r in df.collect()}


def test_odd_rows(spark):
    long = "word " * 60_000 + "end."
    rows = [
        (1, None, None, None), (1, None, "user", "Hi."), (1, 2, "assistant", "Yes."), (1, 2, "assistant", "Yes."),
        (None, 0, "user", "a?"), (None, 5, "assistant", long), (None, 9, "tool", "t　"), (None, 9, "tool", " t!\t"),
        (2, 3, "", ""), (2, 4, "system", "\x0b"), (3, 0, "system", "Be."), (3, 1, "user", "no end"), (3, 7, "user", "No end."), (4, None, "superuser", "x."),
        (5, 0, "assistant", "A."), (5, 1, "user", "A."), (5, 2, "user", "A."), (5, 2, "assistant", "A.")]
    rng = random.Random(9)
    rows += [(6, t, rng.choice(["user", "assistant", "system", "bot"]), rng.choice(["a.", "b", "", f"t{t}."])) for t in range(400)]
    ids = {r[0] for r in rows}
    space = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert answers(repair.repair(frame(spark, rows))) == plain_repair(space, ids)
    assert answers(repair.repair_all(frame(spark, rows), repair.damage(frame(spark, rows)))) == plain_repair(plain_damage(rows), ids)
    assert repair.repair(frame(spark, [])).count() == 0 and repair.repair_all(frame(spark, []), repair.damage(frame(spark, []))).count() == 0


def test_ids_without_rows_are_kept(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = answers(repair.repair_all(frame(spark, [(conv, 0, "user", "Hi.")]), repair.damage(frame(spark, [(conv, 0, "user", "Hi.")]))))
    assert got == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
