"""Conversation repair: the shortest path against all edits, and against SQL."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

import __spark_entry__ as entry
from trackloom.llm import repair

from oracle import compare

CONVERSATIONS = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\v\f\r"


def test_against_sql(spark):
    assert compare(spark, entry, "op13_conversation_repair", "/root/testdata/sf0.001") > 0


def every_edit(rows):
    """All edits with at most two insertions in a place, by trying."""
    found = []

    def go(i, initials, cost, edits):
        if i == len(rows):
            tail([], 0, initials, cost, edits)
            return
        for more in ([], ["u"], ["a"], ["u", "a"], ["a", "u"]):
            initial, gone, ended = rows[i]
            base = (initials + more, cost + 3 * len(more), edits + "I" * len(more))
            go(i + 1, base[0], base[1] + 4, base[2] + "D")
            if not gone:
                extra = 0 if ended else 3
                go(i + 1, base[0] + [initial], base[1] + extra, base[2] + "K")
                for to in "ua":
                    go(i + 1, base[0] + [to], base[1] + 3 + extra, base[2] + "R")

    def tail(_, __, initials, cost, edits):
        for more in ([], ["u"], ["a"], ["u", "a"], ["a", "u"]):
            if re.fullmatch("(s?(ua)+)?", "".join(initials + more)) and len("".join(initials + more)) == len(initials + more):
                found.append((cost + 3 * len(more), edits + "I" * len(more)))

    go(0, [], 0, "")
    return min(found)


def test_shortest_path_equals_all_edits():
    rng = random.Random(9)
    for n in range(5):
        for _ in range(12 if n > 2 else 40):
            rows = [(rng.choice(["s", "u", "a", "t", ""]), rng.random() < 0.2, rng.random() < 0.7) for _ in range(n)]
            at = repair.compose(rows, 0)
            assert min(at[g] for g in repair.ACCEPTED if g in at) == every_edit(rows), rows


def test_pieces_compose_to_the_whole():
    rng = random.Random(4)
    for _ in range(60):
        rows = [(rng.choice("suat"), rng.random() < 0.2, rng.random() < 0.7) for _ in range(rng.randint(0, 30))]
        cuts = sorted(rng.randint(0, len(rows)) for _ in range(3))
        at = {0: (0, "")}
        for lo, hi in itertools.pairwise([0, *cuts, len(rows)]):
            at = repair.multiply(at, {g: repair.compose(rows[lo:hi], g) for g in range(4)})
        whole = repair.compose(rows, 0)
        assert {g: at[g] for g in whole} == whole


def plain(rows):
    """The contract, conversation by conversation in plain Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0)):
            role, text = " " if role is None else role, " " if text is None else text
            k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            kept += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, n, given = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in kept:
            bare = text.rstrip(BLANKS)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            given.append((role[:1], fault in ("blank", "duplicate"), bool(bare) and bare[-1] in ".!?"))
        turns = [t for t, *_ in kept if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(kept))
        at = repair.compose(given, 0)
        cost, edits = min(at[g] for g in (0, 3) if g in at)
        lines, place, rest = [], 0, list(kept)
        for letter in edits:
            if letter == "D":
                rest.pop(0)
                continue
            _, role, text = rest.pop(0) if letter in "KR" else (None, "", "")
            if letter == "K" and role[:1] == "s":
                lines.append(f"{role}:{text}")
                continue
            lines.append((role if letter == "K" else ("user", "assistant")[place % 2]) + ":" + text)
            place += 1
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def of(df):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in df.collect()}


def conversations(rng, n):
    texts = ["Yes.", "No", "Why?", "", " \t", None, "Yes. \n", "a b c!", "né 😀."]
    return [(conv, rng.choice([t, t, t, t + 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ugly"]), rng.choice(texts)) for conv in [*range(n), None] for t in range(rng.randint(1, 9))]


@pytest.mark.parametrize("run", [1, 3, 1024])
def test_equals_plain(spark, monkeypatch, run):
    rows = conversations(random.Random(run), 60)
    monkeypatch.setattr(repair.pieces, "__defaults__", (run,))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], CONVERSATIONS + ", copies string, first long").repartition(6)
    assert of(repair.repair(repair.damaged(df))) == plain(rows)


def test_one_conversation_over_many_tasks(spark):
    rng = random.Random(8)
    rows = [(1, t, ["user", "assistant"][t % 2 if rng.random() < 0.9 else 0], f"turn {t % 700}.") for t in range(3000)] + [(c, 0, "user", "Hi.") for c in (0, 2)]
    assert of(repair.repair(repair.damaged(spark.createDataFrame(rows, CONVERSATIONS)))) == plain(rows)


def test_odd_rows(spark):
    nothing = hashlib.sha256(b"").hexdigest()
    dropped = next((c, t) for c in range(50) for t in range(50) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    rows = [(*dropped, "user", "Gone."), (900, 5, "user", "x" * 300_000 + "."), (900, 6, "assistant", "y " * 100_000 + "!")]
    got = of(repair.repair(repair.damaged(spark.createDataFrame(rows, CONVERSATIONS))))
    assert got == plain(rows) and got[dropped[0]] == (0, 0, 0, 0, 0, 0, "", nothing)
    assert repair.repair(repair.damaged(spark.createDataFrame([], CONVERSATIONS))).count() == 0
