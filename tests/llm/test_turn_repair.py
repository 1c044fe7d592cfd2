"""Conversation repair against a plain search, on hostile rows, and on conversations that are cut into segments."""

import hashlib
import random
import re
import zlib
from itertools import groupby

import pytest

from folio.llm import turn_repair as R

RULE = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, edits string, conv string, n int"


def faults(rows):
    """(role, text, fault) of rows in order."""
    seen, out = set(), []
    for role, text in rows:
        stem = text.rstrip(" \t\n\x0b\x0c\r")
        out.append((role, text, "blank" if not stem else "duplicate" if (role, text) in seen else "truncated" if stem[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def plain(rows):
    """(cost, audit, repaired rows): the least (cost, edits) for each last role, carried forward."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def inserts(states):
        states = dict(states)
        for _ in range(2):
            for st, (cost, audit, body) in list(states.items()):
                to = after[st]
                new = (cost + 3, audit + "I", body + ((name[to], ""),))
                if to not in states or new[:2] < states[to][:2]:
                    states[to] = new
        return states

    states = {"": (0, "", ())}
    for role, text, fault in rows:
        new = {}

        def put(to, cost, audit, body):
            if to not in new or (cost, audit) < new[to][:2]:
                new[to] = (cost, audit, body)

        for st, (cost, audit, body) in inserts(states).items():
            put(st, cost + 4, audit + "D", body)
            if fault in ("blank", "duplicate"):
                continue
            more, i = 3 * (fault == "truncated"), role[:1]
            if (i == "s" and st == "") or (i in "ua" and i == after[st]):
                if i:
                    put(i, cost + more, audit + "K", body + ((role, text),))
            put(after[st], cost + 3 + more, audit + "R", body + ((name[after[st]], text),))
        states = new
    return min((v for k, v in inserts(states).items() if k in ("", "a")), key=lambda v: v[:2])


def expected(rows):
    """The query's row for each conversation of (conv_id, turn, role, text)."""
    out = {}
    space = lambda x: " " if x is None else x
    for conv in {r[0] for r in rows}:
        held = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            fault = zlib.crc32(f"{space(c)}:{space(turn)}".encode()) % 20
            role, text = space(role), space(text)
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            held += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        turns = [r[0] for r in held if r[0] is not None]
        told = faults([r[1:] for r in held])
        count = lambda f: sum(t[2] == f for t in told)  # noqa: E731,B023
        cost, audit, body = plain(told)
        initials = "".join(r[1][:1] or "-" for r in held)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count("blank"), count("duplicate"), count("truncated"), sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1)), cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in body).encode()).hexdigest())
        assert RULE.fullmatch("".join(a[:1] for a, _ in body))
    return out


def query(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = R.op13_conversation_repair(spark, str(tmp_path)).collect()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert len(got) == len({r["conv_id"] for r in got})
    return {r["conv_id"]: tuple(r[n] for n in names) for r in got}


TEXTS = ["Yes.", "No!", "why", "", " \t\r", None, "a\nb?", "été. ", "x" * 3, "...", "a:b\nuser:c."]


def test_random_rows(spark, tmp_path):
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, None, 3, -2]), rng.choice(roles), rng.choice(TEXTS)))
    rows += rng.choices(rows, k=20)
    got, want = query(spark, tmp_path, rows), expected(rows)
    assert {k: v for k, v in got.items() if v != want[k]} == {k: v for k, v in want.items() if v != got[k]}


def test_segments_of_a_huge_conversation(spark, tmp_path):
    """A conversation of more than two segments beside small ones, one that repeats one row, and one without turns."""
    rng = random.Random(6)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["Yes %d." % t, "cut %d" % t, "", "same."])) for t in range(9500)]
    rows += [(8, 2, "user", "again.")] * 5000 + [(9, None, "user", "n%d." % i) for i in range(200)]
    rows += [(c, t, ("user", "assistant")[t % 2], f"{c} {t}.") for c in range(100, 160) for t in range(4)]
    assert query(spark, tmp_path, rows) == expected(rows)


def test_empty_and_dropped(spark, tmp_path):
    rows = [(c, t, "user", "a.") for c in range(40) for t in (0,) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    assert rows
    got = query(spark, tmp_path, rows)
    assert set(got.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())} and len(got) == len(rows)
    assert query(spark, tmp_path / "none", []) == {}


def test_rows_of_the_operator(spark):
    """The operator's own rows: what stays or is put in, in order."""
    given = spark.createDataFrame([("c", 0, "user", "Hello?"), ("c", 1, "user", "Still there?"), ("c", 2, "tool", "Yes.")], "conv string, turn int, role string, text string")
    scratch = R.Scratch(spark, "test")
    rows = R.repaired_rows(R.repaired(R.runs_of(given, scratch), scratch)).orderBy("segment", "place").collect()
    assert [(r["edit"], r["role"], r["text"]) for r in rows] == [("K", "user", "Hello?"), ("I", "assistant", ""), ("K", "user", "Still there?"), ("R", "assistant", "Yes.")]
    scratch.close()


@pytest.mark.parametrize("seed", range(3))
def test_arrays_against_search(seed):
    """Costs and edits of the arrays on random rows."""
    import numpy as np

    rng = random.Random(seed)
    many = [[(rng.choice("suax"), "t%d" % i, rng.choice(["", "", "truncated", "blank"])) for i in range(rng.randrange(1, 9))] for _ in range(300)]
    coded = [bytes(R.CODE.get(r, 3) | {"blank": R.MUST_GO, "truncated": R.TRUNCATED}.get(f, 0) for r, _, f in rows) for rows in many]
    for which in R.buckets([len(c) for c in coded]):
        rows, lengths = R.laid_out(coded, which)
        table = R.costs(rows, lengths, np.broadcast_to(R.with_inserts(R.ENDS), (len(which), 1, 4)))
        edits, _, put, _ = R.trace(rows, lengths, table[:, :, 0], np.zeros(len(which), np.int64), np.ones(len(which), bool))
        for j, i in enumerate(which):
            assert (int(table[0, j, 0, 0]), edits[j, : put[j]].tobytes().decode()) == plain(many[i])[:2]
