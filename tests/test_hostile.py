"""Damaged and hostile files: every table says rows or a typed failure for each, and never fails the others."""

import random

import numpy as np
import pytest
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from folio.kernel.crypt import aes_decrypt, aes_encrypt
from folio.kernel.filters import unpredict
from folio.limits import Limits
from folio.operators import documents as D
from folio.operators import scan
from folio.operators import write as W
from folio.plans import synth as S


def arrow_of(table):
    schema = StructType().add("file_id", "long")
    for f in _parse_datatype_string(scan.SCHEMAS[table]).fields:
        schema.add(f)
    return to_arrow_schema(schema)


def seeds():
    big = b"BT /F1 12 Tf 5000000000 720 Td (far) Tj 1e99 0 Td (x) Tj ET"
    one = S.pdf(S.shown("some text"), big, info={"Title": b"t"}, more=lambda b, r: S.image(b, r, bytes(range(12)), 4, 3))
    return [one, S.pdf(S.shown("packed"), flate=True), S.pdf(S.shown("a"), S.shown("b"), tree={"Rotate": 90})]


def test_mutated_files_through_every_table(spark):
    rng, files = random.Random(11), seeds()
    bits = [b"0", b"99999999999999999999999", b"-1", b"<<", b">>", b"[", b"]", b"obj", b"R", b"/", b"(", b")", b"stream", b"\x00", b"1e400"]
    made = list(files)
    for _ in range(2000):
        data = bytearray(rng.choice(files))
        for _ in range(rng.randrange(1, 6)):
            at = rng.randrange(len(data))
            kind = rng.randrange(3)
            if kind == 0:
                data[at] = rng.randrange(256)
            elif kind == 1:
                data[at : at + rng.randrange(1, 9)] = rng.choice(bits)
            else:
                del data[at : at + rng.randrange(1, 40)]
        made.append(bytes(data))
    limits = Limits(max_stream=1 << 20, max_objects=10_000)
    for table in scan.SCHEMAS:
        found = ((i, len(c), scan.file_rows(table, c, limits, (), "PERMISSIVE", {})) for i, c in enumerate(made))
        seen = set()
        for batch in scan.as_batches(found, arrow_of(table), "PERMISSIVE"):
            seen.update(batch.column("file_id").to_pylist())
        assert {0, 1, 2} <= seen or table in ("toc", "attachments", "streams", "images", "image_data")


def test_numbers_beyond_their_columns_are_pulled_in():
    found = [(0, 1, iter([{"page": 1, "seq": 1, "x": 1 << 40, "y": -(1 << 70), "text": "w"}])), (1, 1, iter([{"page": 1, "seq": 1, "x": 5, "text": "v"}])), (2, 1, iter([{"page": 1, "text": object()}]))]
    rows = [r for b in scan.as_batches(found, arrow_of("words"), "PERMISSIVE") for r in b.to_pylist()]
    assert [(r["file_id"], r["x"], r["y"]) for r in rows[:2]] == [(0, 2**31 - 1, -(2**31)), (1, 5, None)]
    assert rows[2]["status"]["class"] == "parse_error"


def test_assembly_of_unreadable_parts(spark):
    good = seeds()[2]
    files = spark.createDataFrame([(1, good), (2, b"no pdf"), (3, None), (4, good)], "file_id long, content binary")
    from pyspark.sql import functions as F

    joined = {r.file_id: r for r in W.combine(files, F.col("file_id") % 2, F.col("file_id")).collect()}
    assert all(joined[k].content is None and joined[k].status["class"] for k in (0, 1))
    for out in (W.split(files), W.subset(files, [-1]), W.copy_pages(files, [2, 1]), W.rotate_pages(files, [1])):
        rows = out.collect()
        assert sorted(str(r.file_id)[0] for r in rows if r.content is None) == ["2", "3"] and {str(r.file_id)[0] for r in rows if r.content} == {"1", "4"}
    assert sorted(r.file_id for r in W.split(files.where("file_id = 1")).collect()) == ["1_1", "1_2"]
    with pytest.raises(Exception, match="no header"):
        W.split(files.where("file_id = 2"), mode="FAILFAST").collect()
    assert {r.status["class"] for r in D.images(files.where("file_id in (2, 3)")).collect()} == {"parse_error", "invalid_argument"}


def test_aes_of_many_blocks_and_predictors():
    rng = random.Random(2)
    for n in (0, 1, 15, 16, 17, 5000):
        data = rng.randbytes(n)
        assert aes_decrypt(b"k" * 16, aes_encrypt(b"k" * 16, data)) == data
    line = rng.randbytes(30)
    assert unpredict(bytes([1]) + line, 12, 3, 8, 10) == np.cumsum(np.frombuffer(line, np.uint8).reshape(-1, 3), axis=0, dtype=np.uint8).tobytes()
    assert unpredict(bytes([2]) + line + bytes([2]) + line, 12, 3, 8, 10)[30:] == bytes((2 * b) & 255 for b in line)
