"""JSON arrays of documents: written and read by many tasks, whatever the files' size and form."""

import json
import random
import uuid
from pathlib import Path

import pytest
from pyspark.sql.types import ArrayType

from adgauge import schemas
from adgauge.session import scratch_path
from adgauge.sources import readers, sinks

SHAPE = schemas.fields(
    ("id", schemas.LONG), ("text", schemas.TEXT), ("parts", ArrayType(schemas.fields(("name", schemas.TEXT), ("n", schemas.LONG)))), ("m", schemas.TEXT_MAP))


def folder(spark, files):
    path = Path(scratch_path(spark, "arrays").removeprefix("file:"))
    path.mkdir(parents=True)
    for i, content in enumerate(files):
        path.joinpath(f"part-{i}").write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


@pytest.fixture
def split(spark):
    """Blocks of so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(name) for name in names]

    def small(n):
        for name in names:
            spark.conf.set(name, str(n))

    yield small
    for name, value in zip(names, before, strict=True):
        spark.conf.set(name, value)


def document(rng, i):
    bits = ['"', "\\", "{", "}", "[", "]", ",", "},{", '"}', '\\"', "\n", "é", "日本", "plain ", "\\\\"]
    text = lambda n: "".join(rng.choice(bits) for _ in range(rng.randint(0, n)))
    return {
        "id": i, "text": rng.choice([None, text(30), text(300)]),
        "parts": [{"name": text(8), "n": k} for k in range(rng.randint(0, 4))], "m": {text(4): text(6) for _ in range(rng.randint(0, 3))},
    }


def plain(row):
    return json.dumps({"id": row.id, "text": row.text, "parts": row.parts and [p.asDict() for p in row.parts] or [], "m": row.m}, sort_keys=True)


@pytest.mark.parametrize("block", [64, 1000, 1 << 20])
def test_documents_across_blocks_are_whole(spark, split, block):
    rng = random.Random(block)
    given = [document(rng, i) for i in range(400)]
    forms = [dict(), dict(indent=1), dict(ensure_ascii=False), dict(separators=(",", ":"))]
    files = [json.dumps(given[i::4], **forms[i]) + ("" if i % 2 else "\n") for i in range(4)]
    path = folder(spark, [*files, "[]", "", json.dumps(document(rng, 400))])
    split(block)
    rows = readers.read_documents(spark, f"{path}/part-*", SHAPE).collect()
    want = {i: json.dumps(d, sort_keys=True) for i, d in enumerate([*given])}
    got = {r.id: plain(r) for r in rows}
    assert len(rows) == len(got) == 401 and {i: got[i] for i in want} == want


@pytest.mark.parametrize("block", [16, 1 << 20])
def test_folders_name_columns(spark, split, block):
    base = Path(scratch_path(spark, "arrays").removeprefix("file:"))
    for i, name in enumerate(("day=2024-01-02/id=7", "day=2024-01-03/id=8")):
        base.joinpath(name).mkdir(parents=True)
        base.joinpath(name, "part-0").write_text(json.dumps([{"text": f"{i} {k}"} for k in range(5)]))
    shape = schemas.fields(("id", schemas.LONG), ("text", schemas.TEXT))
    want = spark.read.schema(shape).option("multiLine", True).json(str(base))
    split(block)
    got = readers.read_documents(spark, str(base), shape)
    assert got.dtypes == want.dtypes == [("text", "string"), ("day", "date"), ("id", "bigint")]
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 10


def test_several_arrays_in_a_file_are_all_read(spark):
    path = folder(spark, ['[{"id":1},{"id":2}]\n[{"id":3}]\n', '{"id":4}'])
    assert sorted(r.id for r in readers.read_documents(spark, path, SHAPE).collect()) == [1, 2, 3, 4]


@pytest.mark.parametrize("block", [16, 1 << 20])
def test_what_is_left_of_a_broken_file_is_a_row(spark, split, block):
    path = folder(spark, ['[{"id":1},{"id":2},{"id":3,"text":"cut o', '[{"id":4,"parts":[{"name":"a"', '[{"id":5}]', '{"id":6', '[{"id":"x","text":"y"}, no, {"id":7}]'])
    split(block)
    rows = [(r.id, r.text) for r in readers.read_documents(spark, path, SHAPE).collect()]
    assert sorted((i, t) for i, t in rows if i is not None) == [(1, None), (2, None), (5, None)]
    assert len(rows) == 8 and [t for i, t in rows if i is None and t] == ["y"]  # the cut ones, a wrong type, a word before a document


def test_arrays_hold_every_line_once_in_one_array_a_file(spark):
    lines = [json.dumps({"id": i % 700, "text": uuid.uuid4().hex if i % 3 else "same"}) for i in range(1000)]
    path = scratch_path(spark, "exported")
    sinks.export_arrays(spark.createDataFrame([(x,) for x in lines], "value string").repartition(16), path)
    arrays = [json.loads(p.read_text()) for p in Path(path.removeprefix("file:")).glob("part-*")]
    assert len(arrays) == 8 and sorted(json.dumps(d) for a in arrays for d in a) == sorted(lines)
    assert readers.read_documents(spark, path, SHAPE).count() == 1000


def test_no_documents(spark):
    path = scratch_path(spark, "exported")
    sinks.export_arrays(spark.createDataFrame([], "value string"), path)
    assert readers.read_documents(spark, path, SHAPE).count() == 0


def test_query_reads_every_document_when_partitions_stay_small(spark):
    from adgauge.plans import catalog_events  # noqa: F401
    from adgauge.plans.registry import QUERIES

    base, name = scratch_path(spark, "tables"), "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    columns = ["id AS p_partkey", "concat('part ', id) AS p_name", "'b' AS p_brand", "'t' AS p_type", "7 AS p_size", "1.5D AS p_retailprice"]
    spark.range(200).selectExpr(*columns).write.parquet(f"{base}/part.parquet")
    spark.conf.set(name, "false")
    try:
        got = [r.survey_id for r in QUERIES["a07_read_documents"](spark, base).collect()]
    finally:
        spark.conf.set(name, before)
    assert sorted(got) == sorted(f"survey_{n}" for n in range(200))
