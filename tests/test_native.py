"""Assembly by Spark against the sequential writer, byte for byte."""

from pyspark.sql import functions as F

from folio.kernel.serialize import Builder
from folio.kernel.values import Name, Ref
from folio.operators import documents as D
from folio.operators import native as N
from folio.operators import write as W
from folio.plans import synth as S


def linked(*contents, chain=0, cyclic=False, images=False) -> bytes:
    """A file with annotations that point to other pages, a chain of objects, a cycle, dangling references, streams and strings that look like references."""
    def more(b: Builder, res: dict) -> None:
        if chain:
            refs = [b.reserve() for _ in range(chain)]
            for i, r in enumerate(refs):
                b.put(r, {"Next": refs[i + 1]} if i + 1 < chain else "end (5 0 R) \\ \r\n")
            res["Chain"] = refs[0]
        if cyclic:
            a, c = b.reserve(), b.reserve()
            b.put(a, {"To": c, "Self": a, "Gone": Ref(4000, 0)})
            b.put(c, [a, c, {"Deep": [a, [c]]}, 1.5, True, None, Name("A b#c")])
            res["Ring"] = a
        if images:
            S.image(b, res, bytes(range(100)), 10, 10)

    return S.pdf(*contents, more=more, flate=images)


def cross(n: int) -> bytes:
    """Pages that link to each other, and to one of their own kind twice."""
    b = Builder("1.4", S.LETTER)
    f = b.core_font("Courier")
    refs = [b.reserve() for _ in range(n)]
    for i, r in enumerate(refs):
        note = b.add({"Type": Name("Annot"), "P": r, "Dest": [refs[(i + 1) % n], Name("Fit")]})
        b.put(r, {"Type": Name("Page"), "Parent": Ref(2, 0), "Resources": {"Font": {"F1": f}}, "Annots": [note], "Contents": b.stream(S.shown(f"page {i}")), "B": refs[0]} | ({"MediaBox": [0, 0, 10, 10 + i]} if i % 2 else {}))
        b.pages.append(r)
    return b.save()


def both(spark, rows):
    into, order = F.col("doc"), F.col("ord")
    given = spark.createDataFrame(rows, "file_id int, content binary, doc int, ord int").repartition(3)
    got = {r["file_id"]: (bytes(r["content"]) if r["content"] else None, r["status"]["class"]) for r in N.combine(given, into, order).collect()}
    want = {r["file_id"]: (bytes(r["content"]) if r["content"] else None, r["status"]["class"]) for r in W.combine(given, into, order).collect()}
    return got, want


def test_same_bytes(spark):
    rows = [(0, linked(b"a", chain=3, cyclic=True, images=True), 1, 2), (1, cross(5), 1, 1), (2, S.pdf(b"x", b"y"), 1, 3), (3, cross(1), 2, 7), (4, linked(b"", cyclic=True), None, 1), (5, S.pdf(), 3, 0), (1, cross(5), 2, 9), (6, S.pdf(b"z", tree={"MediaBox": [0, 0, 7, 8], "Rotate": 90}), 2, 8)]
    got, want = both(spark, rows)
    assert got == want and set(got) == {None, 1, 2, 3}


def test_a_thousand_deep_and_cyclic(spark):
    got, want = both(spark, [(0, linked(b"deep", chain=1000, cyclic=True), 0, 0), (1, cross(60), 0, 1)])
    assert got == want and len(got[0][0]) > 20_000


def test_bad_parts_are_told(spark):
    rows = [(0, S.pdf(b"a"), 1, 1), (1, b"no file", 1, 2), (2, S.pdf(b"b"), 2, 1), (3, None, 3, 1)]
    got, want = both(spark, rows)
    assert got == want and got[1] == (None, "parse_error") and got[2][1] is None and got[3] == (None, "invalid_argument")


def test_one_document_of_many_parts_is_many_rows(spark):
    """Its bytes come in order from ``segments``, read back, and lie where the cross references say."""
    rows = [(i, linked(S.shown(f"part {i}"), chain=i % 4), 0, i) for i in range(40)]
    given = spark.createDataFrame(rows, "file_id int, content binary, doc int, ord int")
    parts, failed = N.segments(given, F.col("doc"), F.col("ord"))
    held = sorted(parts.collect(), key=lambda r: (r["kind"], r["at"]))
    data = b"".join(bytes(r["data"]) for r in held)
    assert failed.count() == 0 and len(held) > 120 and data.startswith(b"%PDF-1.7") and data.endswith(b"%%EOF\n")
    back = D.page_text(spark.createDataFrame([(0, data)], "file_id int, content binary")).orderBy("page").collect()
    assert [r["text"] for r in back] == [f"part {i}" for i in range(40)]


def test_nothing(spark):
    assert N.combine(spark.createDataFrame([], "file_id int, content binary, doc int, ord int"), F.col("doc"), F.col("ord")).collect() == []
