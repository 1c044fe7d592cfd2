"""Tables of the object graph against the kernel's walks."""

import pytest
from pyspark.sql import functions as F

from folio.kernel.serialize import serialize
from folio.kernel.values import Name, Ref, Stream
from folio.limits import Limits
from folio.operators import documents as D
from folio.operators import graph as G
from folio.plans import synth as S

PAGES, PAGE = {"Type": Name("Pages")}, {"Type": Name("Page")}


def made(tree, *objects, root=None) -> bytes:
    """A file of numbered objects: the catalog is 1, the page tree 2, the others follow; references are taken as they stand."""
    return _saved([{"Type": Name("Catalog"), "Pages": Ref(2, 0)} | (root or {}), tree, *objects])


def _saved(objects) -> bytes:
    out, places = [b"%PDF-1.4\n"], []
    for n, v in enumerate(objects, 1):
        places.append(sum(map(len, out)))
        body = serialize(v.dict | {"Length": len(v.raw)}) + b"\nstream\n" + v.raw + b"\nendstream" if isinstance(v, Stream) else serialize(v)
        out.append(b"%d 0 obj\n" % n + body + b"\nendobj\n")
    at = sum(map(len, out))
    out.append(b"xref\n0 %d\n0000000000 65535 f \n" % (len(places) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places))
    out.append(b"trailer\n" + serialize({"Root": Ref(1, 0), "Size": len(places) + 1}) + b"\nstartxref\n%d\n%%%%EOF\n" % at)
    return b"".join(out)


def frame(spark, files):
    return spark.createDataFrame(list(enumerate(files)), "file_id int, content binary")


def trees():
    """Files whose pages the kernel and the tables must agree on."""
    box = [0, 0, 100, 200]
    yield S.pdf(S.shown("a"), S.shown("b"))
    yield S.pdf(b"", tree={"MediaBox": [0, 0, 10, 20], "Rotate": 90})
    # Three levels, out of number order, attributes at each level, a null that hides, boxes and numbers by reference, corners out of order.
    yield made(PAGES | {"Kids": [Ref(5, 0), Ref(3, 0)], "Count": 4, "MediaBox": Ref(9, 0), "Rotate": 450},
               PAGES | {"Kids": [Ref(4, 0), Ref(7, 0)], "Parent": Ref(2, 0), "CropBox": [Ref(10, 0), 5, 50, 60]}, PAGE | {"Parent": Ref(3, 0), "Rotate": None},
               PAGES | {"Kids": Ref(8, 0), "Parent": Ref(2, 0), "MediaBox": [100, 200, 0, 10]}, PAGE | {"Parent": Ref(5, 0), "Contents": [Ref(11, 0), Ref(11, 0)]},
               PAGE | {"Parent": Ref(3, 0), "MediaBox": [1, 2, 3], "Contents": Ref(11, 0)}, [Ref(6, 0), PAGE | {"Parent": Ref(5, 0), "Rotate": "90"}], box, 7, Stream({}, b"q Q"))
    # A cycle in Kids, a kid that comes twice, kids that are no dictionaries or don't exist, a node without a type.
    yield made(PAGES | {"Kids": [Ref(3, 0), Ref(4, 0), Ref(3, 0), 5, Ref(99, 0), Ref(5, 0)], "Count": 3}, PAGES | {"Kids": [Ref(2, 0), Ref(6, 0)], "Parent": Ref(2, 0)}, PAGE | {"Parent": Ref(2, 0)}, {"Parent": Ref(2, 0)}, PAGE | {"Parent": Ref(3, 0), "MediaBox": box})
    # A cycle of parents: a limit error where an attribute is missing everywhere, none where all are found.
    yield made(PAGES | {"Kids": [Ref(4, 0), Ref(5, 0)], "Parent": Ref(3, 0), "MediaBox": box}, {"Parent": Ref(2, 0)}, PAGE | {"Parent": Ref(2, 0)}, PAGE | {"Parent": Ref(2, 0), "CropBox": box, "Rotate": 0})
    # No pages at all, and a tree that is a page itself.
    yield made(PAGES | {"Kids": [], "Count": 0})
    yield made(PAGE | {"MediaBox": box})


def compared(spark, files, limits):
    f = frame(spark, files)
    names = ("file_id", "page", "media_box", "crop_raw", "rotate_raw", "streams")
    row = lambda r: tuple(tuple(x) if isinstance(x, list) else x for x in (r[n] for n in names)) + (r["status"]["class"], r["status"]["limit"])
    from folio.operators.scan import scan

    want = sorted(map(row, scan(f, "pages", limits=limits).collect()), key=repr)
    got = sorted(map(row, G.raw_pages(D.objects(f, limits=limits), limits).collect()), key=repr)
    return got, want


@pytest.mark.parametrize("limits", [Limits(), Limits(max_depth=5), Limits(max_pages=2)])
def test_pages_from_objects(spark, limits):
    got, want = compared(spark, list(trees()), limits)
    assert got == want and len(got) > 7


def test_a_deep_tree_is_told_and_others_read(spark):
    chain = [PAGES | {"Kids": [Ref(i + 3, 0)], **({"Parent": Ref(i + 1, 0)} if i else {})} for i in range(12)]
    deep = made(chain[0], *chain[1:], PAGE | {"Parent": Ref(13, 0), "MediaBox": [0, 0, 1, 1]})
    got, want = compared(spark, [deep, S.pdf(b"")], Limits(max_depth=8))
    assert got == want and {r[-1] for r in got} == {None, "max_depth"}
    got, want = compared(spark, [deep, S.pdf(b"")], Limits(max_depth=12))
    assert got == want and {r[-1] for r in got} == {None}


def spec(name, data, **more):
    return {"Type": Name("Filespec"), "F": name, "EF": {"F": data}} | more


def name_trees():
    data = [Stream({"Subtype": Name("text/plain"), "Params": {"CreationDate": b"D:20200102030405Z"}}, b"one"), Stream({}, b"two")]
    yield S.pdf(b"")
    # Nested kids, pairs in an inner node, an odd last key, UF before F, no F at all, a cycle, a kid that comes twice.
    yield made(PAGES | {"Kids": [], "Count": 0}, {"EmbeddedFiles": Ref(4, 0)}, {"Names": ["k0", Ref(8, 0)], "Kids": [Ref(5, 0), Ref(6, 0), Ref(5, 0)]},
               {"Names": ["k1", Ref(9, 0), "odd"], "Kids": [Ref(7, 0)]}, {"Names": Ref(12, 0)}, {"Names": ["k2", {"Desc": "no file"}], "Kids": [Ref(4, 0), Ref(6, 0)]},
               spec("plain.txt", Ref(10, 0), Desc="attached"), spec("old.txt", Ref(10, 0), UF="né.txt", EF={"F": Ref(10, 0), "UF": Ref(11, 0)}), *data, [Ref(13, 0), spec("last", Ref(11, 0))], "k3", root={"Names": Ref(3, 0)})


def test_attachments_from_objects(spark):
    f = frame(spark, list(name_trees()))
    names = ("file_id", "ord", "name", "mime", "description", "created", "modified", "data")
    row = lambda r: tuple(bytes(x) if isinstance(x, bytearray) else x for x in (r[n] for n in names))
    want = sorted(map(row, D.attachments(f).collect()), key=repr)
    got = sorted(map(row, G.attachments(D.objects(f), D.streams(f)).collect()), key=repr)
    assert got == want
    assert [r[2] for r in sorted(got)] == ["plain.txt", "né.txt", "k2", "last"]


def test_follow_leaves_the_rest(spark):
    t = G.Tables(spark, "test")
    g = t.put(spark.createDataFrame([(1, 5, '"x"', False), (2, 5, '"y"', True)], "file_id int, number bigint, v string, stream boolean").select("file_id", "number", F.parse_json("v").alias("value"), "stream"), "g")
    rows = spark.createDataFrame([(1, '{"ref":5,"gen":0}'), (1, "7"), (2, '{"ref":6,"gen":0}'), (2, None), (None, '{"ref":5,"gen":0}')], "file_id int, v string").select("file_id", F.parse_json("v").alias("c"))
    got = G.follow(rows, "c", g, "n", "s").select("file_id", F.to_json("c").alias("c"), "n", "s").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, '"x"', 5, False), (1, "7", None, False), (2, None, None, False), (2, None, None, False), (None, None, None, False)], key=repr)
