"""Streaming mining and upserts over several micro-batches and restarts."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from faultline.operators import templates as tp
from faultline.operators.mining_core import MinerConfig
from faultline.plans import all_queries
from faultline.streaming import jobs
from faultline.streaming.buckets import BucketTable, Version
from test_templates import frame, noise


def _file(path, rows, names):
    pq.write_table(pa.table(dict(zip(names, map(list, zip(*rows))))), path)


def test_mining_over_batches_and_a_restart_equals_one_run(spark, tmp_path):
    lines, cfg = noise(90, 4), MinerConfig(sim_th=0.5, max_clusters=3)
    names = ["id", "message", "ts"]
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for k in (0, 1):
        _file(source / f"{k}.parquet", [(i, x, 0) for i, x in enumerate(lines)][k * 30:k * 30 + 30], names)

    def stream():
        sdf = jobs.stream_incremental_files(spark, str(source), spark.read.parquet(str(source)).schema, files_per_trigger=1)
        words = F.when(F.col("message") == "", F.array().cast("array<string>")).otherwise(F.split("message", " "))
        return jobs.stream_mine_templates(sdf.withColumn("tokens", words), "tokens", ["id"], cfg, root)

    assert stream().count() == 60
    _file(source / "2.parquet", [(i, x, 0) for i, x in enumerate(lines)][60:], names)
    cols = ["id", "cluster_id", "change_type", "cluster_size", "template_mined"]
    got = sorted(map(tuple, stream().select(cols).collect()))
    want = tp.mine_templates(frame(spark, lines), "tokens", ["id"], cfg)[0].select(cols).collect()
    assert got == sorted(map(tuple, want))


def test_upserts_over_batches_and_a_restart(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "table")
    source.mkdir()
    base = spark.createDataFrame([(k, "old", k) for k in range(20)], "key long, what string, kept long")
    names = ["key", "what", "seq"]
    for n in range(3):
        _file(source / f"{n}.parquet", [(k, f"batch{n}", n) for k in range(n, 40, 7)], names)

    def run():
        sdf = jobs.stream_incremental_files(spark, str(source), spark.read.parquet(str(source)).schema, files_per_trigger=1)
        return {r.key: (r.what, r.kept) for r in jobs.stream_upsert(sdf, base, ["key"], "seq", root, buckets=4).collect()}

    want = {k: ("old", k) for k in range(20)}
    for n in range(3):
        want.update({k: (f"batch{n}", want.get(k, (None, None))[1]) for k in range(n, 40, 7)})
    assert run() == want
    _file(source / "3.parquet", [(k, "late", 9) for k in (3, 100)], names)
    want.update({3: ("late", 3), 100: ("late", None)})
    assert run() == want and run() == want


def test_an_upserted_table_grows_by_splitting_buckets(spark, tmp_path):
    source, root = tmp_path / "in", tmp_path / "table"
    source.mkdir()
    base = spark.createDataFrame([(k, "old") for k in range(10)], "key long, what string")
    wide = spark.read.schema("key long, what string, seq long")
    held = BucketTable(spark, str(root), base.schema, ["key"], 5)
    want, sizes = {k: "old" for k in range(10)}, []
    for n, some in enumerate([range(5, 60), range(60, 61), [], [3]]):
        _file(source / f"{n}.parquet", [(k, f"batch{n}", n) for k in some] or [(0, "batch2", n)], ["key", "what", "seq"])
        want.update(dict.fromkeys(some or [0], f"batch{n}"))
        sdf = jobs.stream_incremental_files(spark, str(source), wide.parquet(str(source)).schema, files_per_trigger=1)
        got = jobs.stream_upsert(sdf, base, ["key"], "seq", str(root), buckets=2, rows_per_bucket=5)
        assert {r.key: r.what for r in got.collect()} == want and got.count() == len(want)
        sizes.append(held.version(held.last()).buckets)
    assert sizes == [2, 12, 13, 13]
    # a batch of one key writes that key's bucket alone
    old, new = held.version(held.last() - 1), held.version(held.last())
    assert sum(old.held[i] != new.held[i] for i in new.held) == 1 and old.held.keys() == new.held.keys()
    assert sum(rows for _, rows in new.held.values()) == len(want)
    asked = spark.createDataFrame([(3,), (60,), (3,), (999,)], "key long")
    few = held.read(held.last(), asked)
    assert {r.key: r.what for r in few.collect()} == {3: want[3], 60: want[60]} and len(few.inputFiles()) <= 3


def test_buckets_of_every_number_hold_each_key_where_its_split_left_it(spark):
    keys = spark.range(2000).withColumnRenamed("id", "key")
    held = BucketTable(spark, "", keys.schema, ["key"])
    cells = [held.bucket(3, n).alias(f"b{n}") for n in range(3, 30)]
    rows = keys.select(*cells).toPandas()
    for n in range(3, 29):
        before, after = rows[f"b{n}"], rows[f"b{n + 1}"]
        assert set(after) == set(range(n + 1))
        moved = before != after
        assert set(after[moved]) == {n} and set(before[moved]) == {BucketTable._origin(n, Version(3, n, {}))}


def test_files_are_taken_once_over_restarts(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    _file(source / "0.parquet", [(1,)], ["x"])
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")

    def run():
        sdf = jobs.stream_incremental_files(spark, str(source), spark.read.parquet(str(source)).schema)
        sdf.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(
            availableNow=True).start().awaitTermination()
        return sorted(r.x for r in spark.read.parquet(out).collect())

    assert run() == [1]
    _file(source / "1.parquet", [(2,)], ["x"])
    assert run() == [1, 2] and run() == [1, 2]


def test_streams_take_a_table_that_is_a_folder_of_files(spark, tmp_path):
    for name, rows in (("documents", 12), ("events", 60)):
        small = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(rows)
        small.repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    queries = all_queries()[0]
    same = queries["r4_stream_equals_batch"](spark, str(tmp_path)).collect()
    assert same and all(r["same"] for r in same)
    assert queries["r6_stream_incremental_files"](spark, str(tmp_path)).count() == 60


def test_mining_a_stream_without_files_gives_no_lines(spark, tmp_path):
    sdf = jobs.stream_incremental_files(spark, str(tmp_path), frame(spark, []).schema)
    out = jobs.stream_mine_templates(sdf, "tokens", ["id"], MinerConfig())
    assert out.count() == 0 and "template_mined" in out.columns
