"""JSON arrays of documents, cut into documents by many tasks.

Spark's own reader holds the whole array of a file in one task. Here a file is read up to each closing brace, which splits files of
any size and form over tasks, and a document ends where no brace outside a string is open. What a block of a file begins with
(inside a string or not, how many open braces) follows from sums over the blocks before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUMS = "path string, start long, flips boolean, outside long, inside long, n_bytes long"
PARTS = "path string, start long, part int, closes boolean, text binary, folder array<string>"
WHOLE = "text binary, folder array<string>"
QUOTE, OPEN, CLOSE = b'"{}'
AROUND = b"[], \r\n\t"  # what may stand around a document of an array

Block = tuple[str, int, int, list[str]]  # file, where the block begins, bytes of the file, values that its folders name
States = dict[tuple[str, int], tuple[bool, int, int]]


def document_texts(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the files at `path` as `text`, a row each, and what folders name in a struct `folder`, if they do.

    Files are UTF-8; what is left of a broken file is a row too. If files are split, their blocks are counted at once, and
    the documents are cut when the result is read.
    """
    read = spark.read.option("lineSep", "}").text(path)
    named = read.schema.fields[1:]
    pieces = read.select(
        F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"),
        F.array(*[F.col(f"`{f.name}`").cast("string") for f in named]).cast("array<string>").alias("folder"),
    )
    folder = F.struct(*[F.col("folder")[i].cast(f.dataType).alias(f.name) for i, f in enumerate(named)]).alias("folder")
    given = [_trimmed("text"), *[folder] * bool(named)]
    longest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0
    # Spark splits no file that is as short as either
    split = longest > min(_conf_bytes(spark, "openCostInBytes"), _conf_bytes(spark, "maxPartitionBytes"))
    states = _states(pieces) if split else None
    whole = pieces.mapInArrow(lambda batches: _whole(batches, states), WHOLE).select(*given)
    if not split:
        return whole
    # a document that lies in several blocks is put together; a block has two such parts at most
    before = Window.partitionBy("path").orderBy("start", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = pieces.mapInArrow(lambda batches: _parts(batches, states), PARTS)
    numbered = parts.withColumn("n", F.coalesce(F.sum(F.col("closes").cast("long")).over(before), F.lit(0)))
    joined = numbered.groupBy("path", "n").agg(F.array_sort(F.collect_list(F.struct("start", "part", "text"))).alias("parts"), F.first("folder").alias("folder"))
    met = joined.select(F.expr("aggregate(parts, X'', (a, p) -> a || p.text)").alias("text"), "folder").select(*given)
    return whole.unionByName(met.filter("text <> ''"))


def _conf_bytes(spark: SparkSession, name: str) -> int:
    return int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(f"spark.sql.files.{name}")))


def _trimmed(text: str) -> Column:
    return F.btrim(F.col(text).cast("string"), F.lit(AROUND.decode())).alias(text)


def _states(pieces: DataFrame) -> States:
    """Per block that does not begin a file: inside a string, open braces and bytes of the file before its first piece."""
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    told = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    sums = pieces.mapInArrow(_block_sums, SUMS).withColumn("within", told(F.col("flips").cast("long")) % 2 == 1)
    rows = sums.withColumn("depth", told(F.when(F.col("within"), F.col("inside")).otherwise(F.col("outside")))).withColumn("at", told("n_bytes"))
    return {(r.path, r.start): (r.within, r.depth, r.at) for r in rows.filter("start > 0").collect()}


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, list[bytes]]]:
    """(block, pieces): the rows of a batch that belong to one block of a file, in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        paths, starts = batch.column("path"), batch.column("start").to_numpy()
        new = np.flatnonzero(pc.not_equal(paths[1:], paths[:-1]).to_numpy(zero_copy_only=False) | (starts[1:] != starts[:-1])) + 1
        pieces = batch.column("piece").to_pylist()
        for i, j in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows], strict=True):
            yield (paths[i].as_py(), int(starts[i]), batch.column("size")[i].as_py(), batch.column("folder")[i].as_py()), pieces[i:j]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, bytes | None]]:
    """(block, text) with the braces back between pieces, and (block, None) where it ends: the last brace may not be in the file."""
    block = None
    for now, pieces in _runs(batches):
        if block is not None and now != block:
            yield block, None
        yield now, (b"}" if now == block else b"") + b"}".join(pieces)
        block = now
    if block is not None:
        yield block, None


def _marks(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of quotes and braces, whether the quotes so far are odd, and the step of each brace."""
    plain = re.sub(rb"\\.", b"__", text, flags=re.DOTALL) if b"\\" in text else text
    chars = np.frombuffer(plain, np.uint8)
    at = np.flatnonzero((chars == QUOTE) | (chars == OPEN) | (chars == CLOSE))
    found = chars[at]
    return at, np.cumsum(found == QUOTE) % 2 == 1, (found == OPEN).astype(np.int64) - (found == CLOSE)


def _block_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: whether its quotes are odd, the sum of its braces if it begins outside and inside a string, and its bytes."""
    odd, sums, n_bytes = False, [0, 0], 0
    for (path, start, *_), text in _chunks(batches):
        _, flips, step = _marks(b"}" if text is None else text)
        for inside in (False, True):
            sums[inside] += int(step[flips == (odd ^ inside)].sum())
        odd, n_bytes = odd ^ bool(flips[-1:].any()), n_bytes + (1 if text is None else len(text))
        if text is None:
            yield pa.RecordBatch.from_pylist(
                [{"path": path, "start": start, "flips": odd, "outside": sums[0], "inside": sums[1], "n_bytes": n_bytes}], _arrow(SUMS))
            odd, sums, n_bytes = False, [0, 0], 0


def _cut(batches: Iterator[pa.RecordBatch], states: States | None) -> Iterator[tuple[Block, list[bytes], list[tuple[int, bool, bytes]]]]:
    """(block, documents that lie in it, parts of others as (0 at its begin or 1 at its end, whether the document ends, text))."""
    now = None
    for block, text in _chunks(batches):
        if block != now:
            now, rest, lead = block, [], block[1] > 0
            if lead and (states is None or block[:2] not in states):
                raise ValueError("the files are split in another way than when their blocks were counted: read the documents anew")
            inside, depth, n_bytes = states[block[:2]] if lead else (False, 0, 0)
        ended = text is None
        if ended:  # a brace that closes something is in the file, unless the file ends without it
            text = b"}" if (depth > 0 or inside) and n_bytes != block[2] else b""
        at, flips, step = _marks(text)
        within = flips != inside
        levels = depth + np.cumsum(np.where(within, 0, step))
        documents, parts, done = [], [], 0
        for end in (at[~within & (step < 0) & (levels == 0)] + 1).tolist():
            document = b"".join([*rest, text[done:end]])
            if lead:
                parts.append((0, True, document))
            else:
                documents.append(document)
            rest, lead, done = [], False, end
        if done < len(text):
            rest.append(text[done:])
        if len(at):
            inside, depth = bool(within[-1]), int(levels[-1])
        n_bytes += len(text)
        if ended and rest:
            parts.append((1, False, b"".join(rest)))
        yield block, documents, parts


def _whole(batches: Iterator[pa.RecordBatch], states: States | None) -> Iterator[pa.RecordBatch]:
    for (*_, folder), documents, parts in _cut(batches, states):
        if states is None:
            documents += [text for *_, text in parts if text.strip(AROUND)]
        if documents:
            yield pa.RecordBatch.from_arrays([pa.array(documents, pa.binary()), pa.array([folder] * len(documents), pa.list_(pa.string()))], schema=_arrow(WHOLE))


def _parts(batches: Iterator[pa.RecordBatch], states: States) -> Iterator[pa.RecordBatch]:
    for (path, start, _, folder), _, parts in _cut(batches, states):
        if parts:
            rows = [{"path": path, "start": start, "part": n, "closes": closes, "text": text, "folder": folder} for n, closes, text in parts]
            yield pa.RecordBatch.from_pylist(rows, _arrow(PARTS))


def _arrow(shape: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (column.split(" ") for column in shape.split(", "))])
