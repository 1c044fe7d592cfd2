import random
import re


import numpy as np
import pyarrow as pa
import pytest

from folio.llm import jaccard_join, vector_dedup
from folio.llm.components import connected_components
from folio.llm.scratch import Scratch
from folio.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text, words):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(*(w[i:] for i in range(words)))) if len(w) >= words else frozenset([tuple(w)]) if w else frozenset()  # noqa: B905


def components(ids, linked):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {i: root(i) for i in ids}


@pytest.mark.parametrize(("words", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_jaccard_components_against_all_pairs(spark, words, num, den):
    rng = random.Random(words)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", " \n", "One", "one", "one two", "ONE two", "a b c", "A b c"]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 9, 12, 30, 90, 200]))]
        for _ in range(rng.choice([1, 2, 4, 25])):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [texts[-1]] * 3
    rng.shuffle(texts)
    rows = [(10 * i, t, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles int").repartition(5)
    got = {r.doc_id: r for r in jaccard_join.jaccard_components(df, words=words, num=num, den=den).collect()}
    sets = {i: plain_set(t, words) for i, t, _ in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    expected = components(sets, linked)
    assert len(got) == len(rows)
    for i in sets:
        assert (got[i].n_shingles, got[i].component_id) == (len(sets[i]), expected[i])
    kept = jaccard_join.first_of_each_group(df, words=words, num=num, den=den).collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for c in expected.values()})


def test_jaccard_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (6, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard_join.jaccard_components(df).collect())
    assert got == [(-1, 2, 5), (-1, 2, 5), (5, 2, 5), (5, 2, 5), (6, 0, 6)]
    assert sorted(r.text or "" for r in jaccard_join.first_of_each_group(df).collect()) == ["", "a b c d"]
    assert jaccard_join.jaccard_components(df.limit(0)).count() == 0


def test_a_large_group_without_common_centre(spark):
    """Many near copies of which few are linked with the smallest: the tiles must find the others."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(60):
        copy = list(base)
        for k in rng.sample(range(0, 120, 4), 3):
            copy[k] = f"x{rng.randrange(6)}"
        texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: plain_set(t, 3) for i, t in enumerate(texts)}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    expected = components(sets, linked)
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df).collect()} == expected


def test_shingles_of_odd_texts():
    texts = ["", None, "a", "b a", "a b", "A B", "x\ty z w", "é É", "word " * 20_000]
    got = shingle_sets(texts, 3)
    assert [len(s) for s in got] == [0, 0, 1, 1, 1, 1, 1, 1, 1]
    assert list(got[4]) == list(got[5]) != list(got[3])


def test_long_words_do_not_collide():
    t = "a"
    for _ in range(10):
        t += t.translate(str.maketrans("ab", "ba"))
    a, b = shingle_sets([t, t.translate(str.maketrans("ab", "ba"))], 1)
    assert a[0] != b[0]


def test_keys_that_many_classes_share_are_split(spark, monkeypatch):
    """With every key taken for a shared one, the groups stay the same."""
    rng = random.Random(2)
    base = [f"b{i}" for i in range(100)]
    texts = [" ".join(x if rng.random() > 0.01 else f"y{rng.randrange(9)}" for x in base) for _ in range(150)] + [" ".join(rng.sample(base, 60)) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    run = lambda: {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df).collect()}
    whole = run()
    monkeypatch.setattr(jaccard_join, "SAMPLE", 1)
    monkeypatch.setattr(jaccard_join, "SAMPLED_KEY", 2)
    monkeypatch.setattr(jaccard_join, "SALTS", 5)
    assert run() == whole and len(set(whole.values())) < 150


def test_sketch_keys_meet_for_every_linked_pair():
    rng, bands = np.random.default_rng(4), jaccard_join.Bands(90, 100)
    for _ in range(400):
        n = int(rng.integers(9, 800))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        differ = int(rng.integers(1, max(2, 2 * n // 19 + 1)))
        out = int(rng.integers(0, differ + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[out:], rng.integers(0, 2**63, differ - out, dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 90 * (len(a) + len(b) - common):
            assert len(np.intersect1d(bands.keys(np.sort(a)), bands.keys(np.sort(b))))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 200), (7, 7)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame([*links, (None, 1)], "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    rows, n = [], 0
    for label in (0, 1):
        for size in (1, 1, 3, 40, 90):
            centre = rng.normal(size=24)
            for _ in range(size):
                rows.append((n, [float(x) for x in (centre + rng.normal(size=24) * 0.04).astype(np.float32)], label))
                n += 1
    rows += [(n + i, list(rows[5][1]), 0) for i in range(4)]
    n += 4
    odd = [(n, None, 1), (n + 1, [0.0] * 24, 1), (n + 2, [float("nan")] * 24, 1), (n + 3, list(rows[5][1]), None), (n + 4, [None, *rows[5][1][1:]], 0), (n + 5, [], 0), (n + 6, [1e38] * 24, 3), (n + 7, [1e-38] * 24, 3)]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<float>, label int, class string").repartition(5)
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(df).collect()}
    x = np.array([r[1] for r in rows], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    hit = (x @ x.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(hit, False)
    expected = components(range(len(rows)), zip(*np.nonzero(hit), strict=True))
    for i in range(len(rows)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (hit[i].sum(), expected[i], expected[i] == i)
    for r in odd[:6]:
        assert (got[r[0]].n_links, got[r[0]].component_id, got[r[0]].kept) == (0, r[0], True)
    assert got[n + 6].n_links == got[n + 7].n_links == 1
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


def test_vectors_of_a_dense_label(spark):
    """One label of vectors that are all alike but below the bound, with planted pairs: each pair must be found, whatever stands between."""
    rng = np.random.default_rng(3)
    n, dims, pairs = 6000, 64, 500
    alike = np.sqrt(0.95) * np.eye(1, dims)[0] + np.sqrt(0.05) * np.concatenate([np.zeros((n, 1)), (d := rng.normal(size=(n, dims - 1))) / np.linalg.norm(d, axis=1, keepdims=True)], 1)
    off = rng.normal(size=(pairs, dims))
    near = alike[:pairs] + 0.185 * off / np.linalg.norm(off, axis=1, keepdims=True)
    x = np.concatenate([alike, near]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(4)
    got = vector_dedup.near_duplicates(df).toPandas().set_index("vec_id").sort_index()
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    hit = y @ y.T >= 0.98
    np.fill_diagonal(hit, False)
    expected = components(range(len(x)), zip(*np.nonzero(hit), strict=True))
    assert hit.sum() >= 2 * pairs * 0.9
    assert (got.n_links == hit.sum(1)).all(), (int(got.n_links.sum()), int(hit.sum()))
    assert got.component_id.to_dict() == expected


def test_passes_recall_of_a_large_dense_label(spark):
    """20,000 vectors with a mean cosine of 0.9 and planted pairs at 0.981: sorted passes, not tiles, and a recall of 0.95 at least against brute force."""
    rng = np.random.default_rng(12)
    n, dims, pairs = 20_000, 64, 800
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = np.concatenate([np.full((n, 1), np.sqrt(0.9)), np.sqrt(0.1) * unit(rng.normal(size=(n, dims - 1)))], 1)
    off = rng.normal(size=(pairs, dims))
    off -= (off * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    x = np.concatenate([x, 0.981 * x[:pairs] + np.sqrt(1 - 0.981**2) * unit(off)]).astype(np.float32)
    assert vector_dedup.passes_for(len(x), 0.9, 0.98) > 1
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(4)
    got = vector_dedup.near_duplicates(df).toPandas().set_index("vec_id").sort_index()
    y = unit(x.astype(np.float64))
    linked = np.zeros(len(y), np.int64)
    for a in range(0, len(y), 1000):
        linked[a : a + 1000] = (y[a : a + 1000] @ y.T >= 0.98).sum(1) - 1
    assert (got.n_links <= linked).all()
    assert got.n_links.sum() >= 0.95 * linked.sum(), (got.n_links.sum(), linked.sum())


def test_pairs_are_compared_in_bulk_by_parity_bits(monkeypatch):
    rng = np.random.default_rng(7)
    sets = []
    for _ in range(600):
        n = int(rng.integers(1, 300))
        s = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        t = np.concatenate([s[int(rng.integers(0, 1 + n // 5)):], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 5)), dtype=np.uint64)])
        sets.append((np.unique(s), np.unique(t) if len(t) else np.unique(s)))
    na, nb = (np.array([len(x[i]) for x in sets]) for i in (0, 1))
    bits = [[jaccard_join.parity_bits(x[i]) for x in sets] for i in (0, 1)]
    want = []
    for m, p, q in zip(((na + nb) * 20 // 180).tolist(), *bits, strict=True):
        p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
        size = min(len(p), len(q))
        want.append(int(np.bitwise_count(jaccard_join.folded(p, size) ^ jaccard_join.folded(q, size)).sum()) <= m)
    calls, folded = [], jaccard_join.folded
    monkeypatch.setattr(jaccard_join, "folded", lambda *a: (calls.append(1), folded(*a))[1])
    for kind in (pa.binary(), pa.large_binary()):
        # A slice, as a batch's columns may be.
        ba, bb = (pa.array([b"x" * 8, *b], kind).slice(1) for b in bits)
        assert jaccard_join.unlikely_left_out(na, nb, ba, bb, 80, 100).tolist() == want
    assert 0 < sum(want) < len(want) and len(calls) < 120
    assert not len(jaccard_join.unlikely_left_out(na[:0], nb[:0], ba[:0], bb[:0], 80, 100))
