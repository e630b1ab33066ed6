"""A keyed table in buckets that grow in number by linear hashing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from faultline.functions.clock import quoted
from faultline.sources.readers import upsert

#: Rows per bucket on average, beyond which buckets split.
ROWS = 4_000_000
_MANIFEST = "bucket int, batch long, rows long, first int, buckets int"


@dataclass
class Version:
    """What a manifest says: buckets at the start and now, and for each bucket with rows its folder and row count."""

    first: int
    buckets: int
    held: dict[int, tuple[int, int]]


@dataclass
class BucketTable:
    """Folders ``data/batch=<b>/bucket=<i>`` and manifests ``manifest/v=<n>`` below ``root``.

    With ``first * 2^k <= buckets < first * 2^(k+1)`` the level is ``k`` and the split pointer ``buckets - first * 2^k``: a key is in
    bucket ``hash mod first * 2^(k+1)`` if that exists, else in ``hash mod first * 2^k``. One more bucket takes its rows from one
    other, so growing rewrites only buckets that split. A manifest has a row per bucket and is read by the driver; so that
    is rows of the table divided by ``rows_per_bucket``.
    """

    spark: SparkSession
    root: str
    schema: T.StructType
    keys: Sequence[str]
    rows_per_bucket: int = ROWS

    def bucket(self, first: int, buckets: int) -> Column:
        size = first << ((buckets // first).bit_length() - 1)
        key = F.xxhash64(*map(quoted, self.keys))
        wide = F.pmod(key, F.lit(2 * size))
        return F.when(wide < buckets, wide).otherwise(F.pmod(key, F.lit(size))).cast("int")

    def version(self, number: int) -> Version:
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/v={number}").collect()
        return Version(rows[0]["first"], rows[0]["buckets"],
                       {r["bucket"]: (r["batch"], r["rows"]) for r in rows if r["bucket"] is not None})

    def last(self) -> int | None:
        """Number of the newest manifest, ``None`` for a table that does not exist yet."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(path):
            return None
        names = (x.getPath() for x in store.listStatus(path))
        done = [int(p.getName()[2:]) for p in names
                if p.getName().startswith("v=") and store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return max(done, default=None)

    def create(self, base: DataFrame, first: int) -> None:
        """Version 0, with as many buckets as the rows of ``base`` need."""
        buckets = max(first, -(-base.count() // self.rows_per_bucket))
        self._put(Version(first, buckets, self._write(base, first, buckets, -1)), 0)

    def apply(self, batch: DataFrame, number: int, seq: str) -> None:
        """Version ``number + 1`` from version ``number``: buckets that ``batch`` touches or that split are written anew.

        The number of buckets follows from the version before, so a repeated batch writes the same folders.
        """
        old = self.version(number)
        total = sum(rows for _, rows in old.held.values())
        buckets = max(old.buckets, -(-total // self.rows_per_bucket))
        touched = {r[0] for r in batch.select(self.bucket(old.first, old.buckets)).distinct().collect()}
        rewritten = touched | {self._origin(i, old) for i in range(old.buckets, buckets)}
        merged = upsert(self._read(old, rewritten), batch, self.keys, seq)
        written = self._write(merged, old.first, buckets, number)
        kept = {i: x for i, x in old.held.items() if i not in rewritten}
        self._put(Version(old.first, buckets, {**kept, **written}), number + 1)
        if number:
            for i, (folder, _) in self.version(number - 1).held.items():
                if old.held.get(i, (None,))[0] != folder:
                    self._delete(f"{self.root}/data/batch={folder}/bucket={i}")

    def read(self, number: int, wanted: DataFrame | None = None) -> DataFrame:
        """All rows of a version, or those with the keys in ``wanted``, from their buckets only."""
        now = self.version(number)
        if wanted is None:
            return self._read(now, now.held)
        asked = wanted.select(*map(quoted, self.keys)).distinct()
        places = {r[0] for r in asked.select(self.bucket(now.first, now.buckets)).distinct().collect()}
        return self._read(now, places).join(asked, list(self.keys), "left_semi").select(*map(quoted, self.schema.names))

    @staticmethod
    def _origin(bucket: int, old: Version) -> int:
        """The bucket of ``old`` from which a new one takes its rows."""
        while bucket >= old.buckets:
            bucket -= old.first << ((bucket // old.first).bit_length() - 1)
        return bucket

    def _write(self, df: DataFrame, first: int, buckets: int, batch: int) -> dict[int, tuple[int, int]]:
        path = f"{self.root}/data/batch={batch}"
        (df.withColumn("bucket", self.bucket(first, buckets)).repartition("bucket").write.mode("overwrite")
         .partitionBy("bucket").parquet(path))
        stored = self.spark.read.schema(T.StructType([*self.schema, T.StructField("bucket", T.IntegerType())])).parquet(path)
        return {r["bucket"]: (batch, r["count"]) for r in stored.groupBy("bucket").count().collect()}

    def _put(self, new: Version, number: int) -> None:
        rows = [(i, batch, rows, new.first, new.buckets) for i, (batch, rows) in sorted(new.held.items())]
        table = self.spark.createDataFrame([(None, None, None, new.first, new.buckets), *rows], _MANIFEST)
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/v={number}")

    def _read(self, now: Version, wanted) -> DataFrame:
        paths = [f"{self.root}/data/batch={now.held[i][0]}/bucket={i}" for i in sorted(wanted) if i in now.held]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(self.schema).option("basePath", f"{self.root}/data")
        return reader.parquet(*paths).select(*map(quoted, self.schema.names))

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
