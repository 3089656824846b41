import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from plumbline.llm import audits as A, conversations as C
from plumbline.llm.conversations_query import damaged

NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SPACE = " \t\n\x0b\x0c\r"


def digest(text):
    return hashlib.sha256(text.encode()).digest()[:16]


def brute(rows):
    """All cheapest audits as whole strings, row by row."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role if role is not None else " ", text if text is not None else " "))
    return sorted((judge(conv, sorted(said, key=lambda r: (*r[:3], digest(r[3])))) for conv, said in convs.items()), key=str)


def judge(conv, said):
    faults, seen = [], set()
    for _, _, role, text in said:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = {t for has, t, *_ in said if has}
    ways = {"": (0, "", [])}  # initials so far (as far as they matter) -> cost, audit, messages

    def form(done, initial):
        return re.fullmatch(r"s?(ua)*u?", done + initial) is not None

    def short(done):
        return done if len(done) < 3 else ("x" if False else done[0] * (done[0] == "s") + "ua" + "u" * (len(done.lstrip("s")) % 2))

    def offer(new, done, way):
        done = short(done)
        if done not in new or way[:2] < new[done][:2]:
            new[done] = way

    def inserts(new):
        for _ in range(4):
            for done, (cost, audit, out) in list(new.items()):
                for role in ("user", "assistant"):
                    if form(done, role[0]):
                        offer(new, done + role[0], (cost + 2, audit + "I", [*out, f"{role}:"]))

    inserts(ways)
    for (_, _, role, text), fault in zip(said, faults):
        new = {}
        for done, (cost, audit, out) in ways.items():
            offer(new, done, (cost + 3, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            if role and form(done, role[0]):
                offer(new, done + role[0], (cost + more, audit + "K", [*out, f"{role}:{text}"]))
            for other in ("user", "assistant"):
                if form(done, other[0]):
                    offer(new, done + other[0], (cost + 2 + more, audit + "R", [*out, f"{other}:{text}"]))
        inserts(new)
        ways = new
    cost, audit, out = min((w for done, w in ways.items() if re.fullmatch(r"(s?(ua)+)?", done)), key=lambda w: w[:2])
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(said, said[1:])]
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    counts = [faults.count(n) for n in ("blank", "duplicate", "truncated")]
    illegal = sum(p not in ("su", "ua", "au") for p in pairs)
    return (conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


@pytest.fixture
def talk(spark):
    return lambda rows: spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)


def result(df, **more):
    return sorted((tuple(r[n] for n in NAMES) for r in C.repair(df, **more).collect()), key=str)


def random_rows(rng, conversations, longest):
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randrange(longest) + 1):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "uSer", "User"])
            text = rng.choice(["Hello.", "Why?", "cut off", " ", "", None, f"Say {rng.randrange(9)}!", "end. \n", "é…", "x.\x85"])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, turn + 2, None]), role, text))
    return rows


def test_random_conversations_equal_brute_force(talk):
    rows = random_rows(random.Random(11), 250, 9)
    assert result(talk(rows)) == brute(rows)


def test_long_conversation_over_many_segments(spark, talk, monkeypatch):
    """One conversation with most rows, cut into many ranges and segments, and short ones around it."""
    monkeypatch.setattr(C, "SEGMENT", 7)
    rng = random.Random(4)
    rows = [r for r in random_rows(rng, 40, 6) if r[0] is not None]
    rows += [(20, 100 + i, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"c{i}.", ""])) for i in range(900)]
    assert result(talk(rows)) == brute(rows)


def test_hot_copies(talk):
    rows = [(1, 5, "user", "Same.")] * 300 + [(1, i, "user", "Same.") for i in range(300)] + [(2, 0, "assistant", "Yes.")]
    assert result(talk(rows)) == brute(rows)


def test_repaired_messages(talk):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Well?"), (1, 2, "user", "Well?"), (1, 3, "assistant", "So"), (2, 0, "system", "Be."), (2, 1, "user", "Go.")]
    said = {}
    for r in sorted(C.repaired_messages(talk(rows)).collect(), key=lambda r: (r.conv_id, r.position)):
        said.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for row in brute(rows):
        assert hashlib.sha256("\n".join(said.get(row[0], [])).encode()).hexdigest() == row[-1]


def damage(rows):
    """The contract's damage, row by row, and all conversations."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    return out


def test_damaged_rows(spark, talk):
    rows = random_rows(random.Random(8), 300, 4)
    found = result(damaged(talk(rows)), copies="copies")
    left = damage(rows)
    empty = hashlib.sha256(b"").hexdigest()
    gone = {r[0] for r in rows} - {r[0] for r in left}
    assert gone and found == sorted(brute(left) + [(c, 0, 0, 0, 0, 0, 0, "", empty) for c in gone], key=str)


def test_empty_table_extremes_and_clashing_columns(talk, clashing):
    assert result(talk([])) == []
    rows = [(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b."), (2, 3, "user", "word " * 20_000 + "."), (2, 4, "assistant", "x " * 9)]
    df = clashing(talk(rows)).withColumn("_conv", F.lit("mine")).withColumn("audit", F.lit("mine"))
    found = result(df)
    expected = brute(rows)
    assert [r[2:] for r in found] == [r[2:] for r in expected] and found[0][1] == -2


def test_audits_order_strings_and_survive_equal_hashes(monkeypatch):
    rng = random.Random(1)
    for base in (A._BASE, 1, 0):  # with 1 and 0 nearly all hashes are equal
        monkeypatch.setattr(A, "_BASE", base)
        store, nodes = A.Audits(), [0]
        for _ in range(120):
            nodes.append(store.add(rng.choice(nodes[-30:]), "".join(rng.choice("DIKR") for _ in range(rng.choice([1, 1, 1, 5])))))
        for _ in range(1500):
            a, b = rng.choice(nodes), rng.choice(nodes)
            assert store.less(a, b) == (store.text(a) < store.text(b))
