"""Hard negatives against brute force: given tables, hostile rows, many small blocks and waves."""

import math
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest

from folio.llm import hard_negatives as H

NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows, every=100):
    """Rows (vec_id, embedding, label) -> the query's rows."""
    held = []
    for i, vec, label in rows:
        if i is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        held.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in vec]))
    out = []
    for i, label, vec in held:
        if i % every:
            continue
        scores = [(sum(a * b for a, b in zip(vec, v)), j, l) for j, l, v in held if len(v) == len(vec)]
        near = sorted((-s, j) for s, j, l in scores if l == label and j != i)[:5]
        for ps, p in near:
            found = sorted((-s, j) for s, j, l in scores if l != label and 30 * -ps <= 100 * s <= 90 * -ps)[:10]
            out += [(i, p, r, j, -ps, -s) for r, (s, j) in enumerate(found, 1)]
    return sorted(out)


def query(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<float>, label int, row string, score int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(tuple(r[n] for n in NAMES) for r in H.op12_hard_negatives(spark, str(tmp_path)).collect())


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no driver tables")
def test_given_table(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = c.sql(H.OP12_SQL)
    at = [want.columns.index(n) for n in NAMES]
    got = sorted(tuple(r[n] for n in NAMES) for r in H.op12_hard_negatives(spark, sf).collect())
    assert got and got == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_hostile_rows_in_small_blocks(spark, tmp_path, monkeypatch):
    """Ties, repeated rows, zero vectors, other lengths, nulls, infinities and negative ids; blocks of 16 rows, waves that double."""
    for name, n in (("BLOCK_ROWS", 16), ("ANCHOR_ROWS", 3), ("WAVE", 2)):
        monkeypatch.setattr(H, name, n)
    rng = random.Random(3)
    rows = []
    for i in range(-100, 501):
        base = [rng.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(6)]
        rows.append((i, base, rng.choice([0, 0, 0, 1, 2, 9])))
    rows += [(i, [0.0] * 6, 1) for i in (600, 601)] + [(i, [0.5] * 4, i % 3) for i in range(700, 760)]
    rows += [(800, None, 1), (801, [0.5] * 6, None), (None, [0.5] * 6, 1), (900, [0.5, None, 0.5, 0.5, 0.5, 0.5], 1), (1000, [math.nan] * 6, 1), (1100, [math.inf] + [0.5] * 5, 0), (1200, [], 0), (1201, [], 1), (1202, [], 0)]
    rows += [rows[150], rows[200], rows[200], rows[333]]
    assert query(spark, tmp_path, rows) == brute(rows)


def test_empty_and_alone(spark, tmp_path):
    assert query(spark, tmp_path / "a", []) == []
    assert query(spark, tmp_path / "b", [(100, [1.0, 2.0], 3), (101, [1.0, 2.0], 4)]) == []


def test_bracket_holds():
    """The score lies within its bracket, and near pairs have narrow ones."""
    rng = np.random.default_rng(1)
    vecs = np.floor(rng.normal(size=(400, 16)) * 256)
    square = (vecs * vecs).sum(1)
    most = square.max()
    pivots = np.column_stack([vecs[:8], np.sqrt(most - square[:8])])
    anchors = vecs[100:150]
    low, high = H.bracket(H.distances(anchors, square[100:150], most, pivots, True), square[100:150], H.distances(vecs, square, most, pivots, False), most)
    exact = anchors @ vecs.T
    assert (low <= exact).all() and (exact <= high).all() and (high - low < 4 * most).any()
