"""Operator 4, token ids in Parquet list columns.

Documents are dealt out by ranges of doc_id, sorted, encoded, and written as
Parquet with dictionary pages and, where a dictionary grows too large, delta
encoding (version 2 pages), row groups and pages of a chosen size, and the page indexes that the
writer adds. A reader can then take single columns (ids or the narrow
metadata) and single pages of a doc_id range.

Defined cases: a missing text counts as empty and holds the end id only; rows
that share a doc_id are ordered by a hash of their text; a missing doc_id comes
first; an empty table gives an empty dataset.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path
from .tokens import encoder

END = 2
ROW_GROUP, PAGE = 32 << 20, 256 << 10


def write_tokens(documents: DataFrame, out: str, tokenizer: str, end: int = END, row_group: int = ROW_GROUP, page: int = PAGE) -> None:
    """Writes doc_id, ids, n_tokens, part and before (the ids earlier in the part) in ascending doc_id order."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, ids_of = TaskContext.get().partitionId(), 0, encoder(tokenizer).encode
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                some = b.slice(at, 2000)
                ids = [ids_of(t) + last for t in some.column(0).to_pylist()]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                ends = np.cumsum([0, *n])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([some.column(1), lists, pa.array(n), pa.array(np.full(len(n), part, np.int32)), pa.array(before + ends[:-1])], names=["doc_id", "ids", "n_tokens", "part", "before"])
                before += int(ends[-1])

    texts = documents.select(F.col("text").cast("string").alias("text"), "doc_id").withColumn("h", F.xxhash64("text"))
    dealt = texts.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("text", "doc_id")
    encoded = dealt.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens bigint, part int, before bigint")
    (
        encoded.write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "true")
        .option("parquet.block.size", row_group).option("parquet.page.size", page).option("parquet.dictionary.page.size", 1 << 20).parquet(out)
    )


def read_tokens(spark: SparkSession, path: str, doc_id: str = "bigint") -> DataFrame:
    return spark.read.schema(f"doc_id {doc_id}, ids array<int>, n_tokens bigint, part int, before bigint").parquet(path)


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(0)
        raw, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
        crc = [zlib.crc32(raw[x:y].tobytes()) for x, y in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(crc, pa.int64())], names=[*b.schema.names[1:], "ids_crc32"])


def digest(stored: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: totals per part from the metadata columns alone, then one read of the ids."""
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    starts = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))  # one row a file
    kind = stored.schema["doc_id"].dataType.simpleString()
    rows = stored.select("ids", "doc_id", "n_tokens", "part", "before").mapInArrow(_crc, f"doc_id {kind}, n_tokens bigint, part int, before bigint, ids_crc32 bigint")
    return rows.join(F.broadcast(starts), "part").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_dataset(documents: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Writes the dataset to the shared folder and returns what is read back."""
    out = new_path(documents.sparkSession, "tokens")
    write_tokens(documents, out, tokenizer, end)
    return digest(read_tokens(documents.sparkSession, out, documents.schema["doc_id"].dataType.simpleString()))
