"""The whole pipeline on a small table, each stage held against a plain version of it; and clashing names, nulls and repeated rows in every stage."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from folio.llm import language_id, packing, pii

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
EXTRA = ["lang_pred", "_source_size", "_times", "_size", "_copies", "row", "copy", "c0", "r0", "spans", "sequence_id", "length", "h", "found"]
WORDS = {"en": "the of and to in that was his he it with is for as had you not be her on".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split()}


def table():
    rng = random.Random(3)
    rows = []
    for i in range(60):
        lang = ("en", "de")[i % 2]
        text = " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", f"x{rng.randrange(90)}"]) for _ in range(rng.randrange(20, 90)))
        rows.append([i, text + (f" mail a{i}@b.org or 10.0.0.{i}" if i % 5 == 0 else ""), None if i % 7 == 0 else lang, rng.choice(["a", "b", None]), len(text)])
    rows += [[100 + i, rows[4][1], "en", "a", 1] for i in range(4)] + [[200, rows[8][1] + " more", "en", "a", 1], [200, rows[9][1], "de", None, 1], [None, rows[9][1], "de", "c", 1]]
    rows += [[300, None, "en", "a", 0], [301, "", None, "b", 0], [302, "123 ½ !", "de", "b", 7], [303, "word " * 5000, "en", "b", 5]]
    return rows


def plain_copies(rows):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = [b if u == a else u for u in up]
    return Counter(up)


@pytest.mark.parametrize("extra", [False, True])
def test_stages_against_plain_versions(spark, tmp_path, extra):
    rows = table()
    names = COLUMNS + (EXTRA if extra else [])
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{n}` string" for n in names[5:])
    sf = str(tmp_path)
    spark.createDataFrame([(*r, *["x"] * len(names[5:])) for r in rows], schema).repartition(3).write.parquet(f"{sf}/documents.parquet")
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        seen.append([r.asDict() for r in docs.collect()])
        if name != "packing":
            assert docs.columns == names
    kept, first, clean, mixed, packed = seen
    as_rows = lambda found: Counter(tuple(r[c] for c in COLUMNS) for r in found)
    assert as_rows(kept) == Counter(tuple(r) for r in rows if r[1] and language_id.WORD.search(r[1]))
    given = [[r[c] for c in COLUMNS] for r in kept]
    assert len(first) == len(plain_copies(given)) and not as_rows(first) - as_rows(kept)
    assert 302 not in [r["doc_id"] for r in kept]
    field = pii.train()
    expected = Counter()
    for r in first:
        text = pii.redacted(r["text"], pii.find([r["text"]], field)[0][1])
        expected[r["doc_id"], text, r["lang"], r["source"], len(text)] += 1
    assert as_rows(clean) == expected and not any("@" in r["text"] for r in clean)
    times, sizes, taken = as_rows(mixed), Counter(), Counter()
    assert set(times) <= set(as_rows(clean)) and all(n <= 2 * as_rows(clean)[k] for k, n in times.items())
    for r in clean:
        sizes[r["source"]] += len(r["text"].split())
    for r in mixed:
        taken[r["source"]] += len(r["text"].split())
    # a, b, c and null weigh 5, 2, 1 and 5 of 150% of all, and twice their size at most; a document is 5,000 words at most.
    assert all(taken[s] <= 2 * sizes[s] for s in sizes) and abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 5000
    tok = packing.PieceTokenizer(packing.vocabulary())
    assert sum(r["length"] for r in packed) == sum(len(tok.whole(r["text"])) // 4 + 1 for r in mixed)
    by = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 1024


def test_run_is_the_stages_one_after_the_other(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([tuple(r) for r in table()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf)
    whole = lambda df: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert whole(pipeline.run(spark, sf)) == whole(docs)


def test_unlabelled_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(1, "some text", None, "a", 9), (2, "½", None, "a", 1), (3, None, None, None, 0)], schema)
    assert [r.doc_id for r in pipeline.language(spark, df, "").collect()] == [1]
    docs = df.limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
