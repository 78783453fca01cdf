"""Conversation repair against string dynamic programming and full enumeration, in chunks of any size."""

import hashlib
import re
import zlib
from itertools import product

import numpy as np
import pytest

from docweave.llm import turn_repair
from docweave.llm.queries import QUERIES, damaged_turns

BLANK = re.compile(r"[^\x20\x09-\x0D]")
AFTER = {"": ("user", "U"), "S": ("user", "U"), "U": ("assistant", "A"), "A": ("user", "U")}


def judged(rows):
    """``(turn, role, text, fault)`` in order."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda e: (e[0] is not None, e[0], hashlib.md5(f"{len(e[1])}:{e[1]}:{e[2]}".encode()).hexdigest()))
    seen, out = set(), []
    for t, r, x in rows:
        last = (BLANK.findall(x) or [""])[-1]
        fault = "blank" if not last else "duplicate" if (r, x) in seen else "truncated" if last not in ".!?" else ""
        seen.add((r, x))
        out.append((t, r, x, fault))
    return out


def options(state, role, text, fault):
    """``(letters, cost, lines, state)`` of all ways past one turn."""
    letters, cost, lines = "", 0, []
    for _ in range(3):
        who, to = AFTER[state]
        yield letters + "D", cost + 3, lines, state
        if fault not in ("blank", "duplicate"):
            more = fault == "truncated"
            yield letters + "R", cost + 2 + more, [*lines, f"{who}:{text}"], to
            if role[:1] == who[0]:
                yield letters + "K", cost + more, [*lines, f"{role}:{text}"], to
            if role[:1] == "s" and state == "":
                yield letters + "K", cost + more, [*lines, f"{role}:{text}"], "S"
        letters, cost, lines, state = letters + "I", cost + 2, [*lines, f"{who}:"], to


def plain(rows):
    rows = judged(rows)
    best = {"": (0, "", [])}
    for _, role, text, fault in rows:
        new = {}
        for s, (cost, audit, lines) in best.items():
            for letters, price, put, to in options(s, role, text, fault):
                new[to] = min(new.get(to, (1 << 60,)), (cost + price, audit + letters, lines + put))
        best = new
    ends = [best[s] for s in ("", "A") if s in best]
    ends += [(c + 2, a + "I", x + ["assistant:"]) for c, a, x in [best["U"]] if "U" in best] if "U" in best else []
    ends += [(best["S"][0] + 4, best["S"][1] + "II", best["S"][2] + ["user:", "assistant:"])] if "S" in best else []
    cost, audit, lines = min(ends)
    turns = [t for t, *_ in rows if t is not None]
    first = [r[:1] for _, r, _, _ in rows]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(sum(f == k for *_, f in rows) for k in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def enumerated(rows):
    """Cost and letters over all ways, without a program over states."""
    rows = judged(rows)
    found = [("", 0, "")]
    for _, role, text, fault in rows:
        found = [(to, c + price, a + letters) for s, c, a in found for letters, price, _, to in options(s, role, text, fault)]
    tails = {"": [(0, "")], "A": [(0, "")], "U": [(2, "I")], "S": [(4, "II")]}
    return min((c + p, a + x) for s, c, a in found for p, x in tails[s])


def run(spark, rows, chunk):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, c string, pos int")
    faults, repaired = turn_repair.repair(df, chunk=chunk)
    counts = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal) for r in faults.collect()}
    digest = {r.conv_id: (r.cost, r.audit, r.repaired_sha256) for r in turn_repair.digests(repaired).collect()}
    assert set(counts) == set(digest)
    return {c: counts[c] + digest[c] for c in counts}, repaired


def conversations(seed, n, longest):
    rng = np.random.default_rng(seed)
    texts = ["Yes.", "No!", "Why?", "open", "", " \n", "a. b", "Fine.\t", "long " * 400 + ".", None]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "Assistant"]
    rows = []
    for conv in range(n):
        for turn in range(int(rng.integers(1, longest))):
            rows.append((conv, None if rng.random() < 0.05 else int(turn + rng.integers(0, 2)), roles[int(rng.integers(0, 9 if conv % 3 else 3))],
                         (texts[int(rng.integers(0, 10))] or "") + ("" if rng.random() < 0.5 else f"{turn}.") if rng.random() < 0.9 else None))
    return rows


def by_conversation(rows):
    out = {}
    for c, *rest in rows:
        out.setdefault(c, []).append(tuple(rest))
    return out


@pytest.mark.parametrize("chunk", [1, 3, 1024])
def test_against_strings(spark, chunk):
    rows = conversations(chunk, 40, 14)
    rows += [(None, 1, "user", "A."), (None, 0, "system", "B."), (77, None, None, None)]
    rows += [(500, i, ("user", "assistant")[i * 7 % 5 % 2], f"turn {i % 60}.") for i in range(300)]  # one holds much of the table
    got, repaired = run(spark, rows, chunk)
    assert got == {c: plain(r) for c, r in by_conversation(rows).items()}
    left = {}
    for r in repaired.filter("edit <> 'D'").orderBy("pos", "step").collect():
        left[r.conv_id] = left.get(r.conv_id, "") + r.role[0]
    assert left and all(re.fullmatch("(s?(ua)+)?", x) for x in left.values())
    inserted = repaired.filter("edit = 'I'")
    assert inserted.count() and inserted.filter("text <> '' or role not in ('user', 'assistant')").count() == 0


def test_enumeration():
    for roles in product(["system", "user", "assistant", "tool"], repeat=3):
        for marks in product(["Yes {}.", "no {}", ""], repeat=3):
            rows = [(i, r, m.format(i)) for i, (r, m) in enumerate(zip(roles, marks))]
            assert plain(rows)[5:7] == enumerated(rows)


def test_damage_and_query(spark):
    given = spark.createDataFrame([(c, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}. Done!") for c in range(60) for t in range(6)]
                                  + [(None, None, None, None)], "conv_id bigint, turn bigint, role string, text string")
    expected = []
    for c, t, r, x in map(tuple, given.collect()):
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = (" " if v is None else v for v in (r, x))
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        expected += [(c, t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert sorted(map(str, map(tuple, damaged_turns(given).collect()))) == sorted(map(str, expected))


def test_query_keeps_conversations_without_rows(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "Hello.")], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in QUERIES["op13_turn_repair"](spark, str(tmp_path)).collect()] == [
        (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_empty_and_long(spark):
    empty = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert [df.count() for df in turn_repair.repair(empty)] == [0, 0]
    long = spark.createDataFrame([("a", 0, "user", "x " * 200_000 + " " * 100_000), ("a", 1, "assistant", "y" * 300_000 + "?")],
                                 "conv_id string, turn int, role string, text string")
    faults, repaired = turn_repair.repair(long)
    assert tuple(faults.first()) == ("a", 0, 0, 0, 1, 0) and [r.edit for r in repaired.orderBy("pos", "step").collect()] == ["K", "K"]
