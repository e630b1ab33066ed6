"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are range-partitioned and sorted by id, so each file, stripe and row group holds a short id range. A reader
that asks for some ids opens only the stripes whose ranges and Bloom filters admit them; a full scan reads stripes in
parallel. Every row knows where its ids start within its file, and files are numbered in id order, so the global start
needs the files' totals only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from faultline.llm.common import slices
from faultline.llm.tokens import encoder as encoder_of

ROW_INDEX_STRIDE = 1000
STRIPE_BYTES = 16 << 20


def write_token_orc(docs: DataFrame, path: str, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Write ``doc_id, part, start_in_part, n_tokens, ids`` in ascending id order.

    A null or empty text has the end id alone. Null ids come first; rows of one id are ordered by a hash of their text,
    so equal rows tie without effect. Other columns of ``docs``, whatever their names, are left out.
    """
    schema = "doc_id long, part int, start_in_part long, n_tokens int, ids array<int>"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, start = encoder_of(vocabulary), TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text"):
            ids, counts = encoder.encode(batch.column("text"))
            offsets = np.concatenate([[0], np.cumsum(counts)])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.full(len(counts), part, np.int32)), pa.array(start + offsets[:-1]),
                pa.array(counts.astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))],
                names=["doc_id", "part", "start_in_part", "n_tokens", "ids"])
            start += int(offsets[-1])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("binary").alias("text"))
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    (rows.mapInArrow(encode, schema).write.option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id")
     .option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true")
     .option("orc.row.index.stride", str(ROW_INDEX_STRIDE)).option("orc.stripe.size", str(STRIPE_BYTES)).orc(path))


def read_token_orc(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """The rows of the files; ``ids`` reaches the scan as a filter that skips files, stripes and row groups."""
    rows = spark.read.schema("doc_id long, part int, start_in_part long, n_tokens int, ids array<int>").orc(path)
    return rows if ids is None else rows.filter(F.col("doc_id").isin(ids))


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """``part, before``: ids in all earlier files. One row per file; reads two columns."""
    ends = (read_token_orc(spark, path).groupBy("part")
            .agg(F.max(F.col("start_in_part") + F.col("n_tokens")).alias("total")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""
    schema = "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.cumsum(batch.column("n_tokens").to_numpy()).tolist()
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("part"), batch.column("start_in_part"),
                batch.column("n_tokens").cast(pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    rows = read_token_orc(spark, path).mapInArrow(digest, schema)
    return (rows.join(file_starts(spark, path), "part")
            .select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32"))
