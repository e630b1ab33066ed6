"""Nothing is dropped without a word: components, window grids, categories, caps; plans that read what they must."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Window, functions as F

from faultline.operators import aggregates as agg
from faultline.operators import features as ft
from faultline.operators import filters, joins, rolling
from faultline.operators import templates as tp
from faultline.operators.mining_core import MinerConfig, Shard
from faultline.sources import readers as rd


def test_components_are_found_or_refused(spark):
    polls = spark.createDataFrame([("d", 1, "FPC 0", 5.0, 1), ("d", 1, "FPC 9", 7.0, 1), ("d", 2, None, 1.0, 1)],
                                  "ip string, time int, component string, cpu double, job_id int")
    wide = agg.pivot_components(polls, ["ip", "time"], "component", ["cpu"]).collect()
    assert [r.asDict() for r in wide] == [{"ip": "d", "time": 1, "FPC 0": 5.0, "FPC 9": 7.0}]
    with pytest.raises(PySparkException, match="FPC 9"):
        agg.pivot_components(polls, ["ip", "time"], "component", ["cpu"], ["FPC 0"]).collect()
    with pytest.raises(ValueError):
        agg.component_names(polls, "component", most=1)


def test_windows_off_the_grid(spark):
    windows = spark.createDataFrame([("d", dt.datetime(2024, 1, 1, 0, 0, 7))], "ip_address string, window_5min_end timestamp")
    hits = spark.createDataFrame([("d", dt.datetime(2024, 1, 1, 0, 10, 7))], "ip_address string, time timestamp")
    assert [r.label for r in joins.label_future_windows(windows, hits).collect()] == [1]
    with pytest.raises(PySparkException, match="grid"):
        joins.label_future_windows(windows, hits, grid=300).collect()


def test_categories_are_bounded(spark, monkeypatch):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("Z",)], "c string")
    assert ft.fit_categories(df, ["c"]) == {"c": ["Z", "a", "b", None]}
    monkeypatch.setattr(ft, "MAX_CATEGORIES", 3)
    with pytest.raises(ValueError):
        ft.fit_categories(df, ["c"])


def test_set_engine_has_no_cap_over_words_by_default():
    shard = Shard(MinerConfig(sim_th=0.9, max_clusters=1, engine="jaccard"))
    for i in range(4):
        shard.add(["A", f"x{i}", f"y{i}", f"z{i}"], i)
    assert len(shard.templates) == 4 and not shard.evicted
    capped = Shard(MinerConfig(sim_th=0.9, max_clusters_per_word=2, engine="jaccard"))
    for i in range(4):
        capped.add(["A", f"x{i}", f"y{i}", f"z{i}"], i)
    assert len(capped.templates) == 2 and capped.evicted


def test_set_engine_strategies(spark):
    cfg = MinerConfig(sim_th=0.4, depth=4, engine="jaccard")
    rows = [(i, x.split()) for i, x in enumerate(["run alpha beta gamma", "run delta eps zeta"])]
    catalog = tp.mine_templates_jaccard(spark.createDataFrame(rows, "id int, tokens array<string>"), "tokens", ["id"], cfg)[1].cache()
    asked = spark.createDataFrame([("run gamma beta alpha".split(),), ("run alpha beta gamma".split(),), (["no"],)],
                                  "tokens array<string>")
    got = {s: {" ".join(r.tokens): r.template for r in tp.match_templates_jaccard(asked, catalog, cfg, strategy=s).collect()}
           for s in ("never", "fallback", "always")}
    assert got["never"] == {"run alpha beta gamma": "run alpha beta gamma"}
    assert got["fallback"] == got["always"] == {**got["never"], "run gamma beta alpha": "run alpha beta gamma"}


def test_pending_dates_prune_folders(spark, tmp_path):
    df = spark.range(30).withColumn("ts", F.timestamp_seconds(F.col("id") * 20_000))
    rd.export_by_date(df, "ts", str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    done = spark.createDataFrame([(dt.date(1970, 1, 5),)], "date date")
    pending = rd.pending_dates(stored, done)
    assert {r.date for r in pending.select("date").distinct().collect()} == {dt.date(1970, 1, d) for d in (6, 7)}
    plan = pending._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert rd.pending_dates(stored, done.limit(0)).count() == 30


def test_rolling_sums_against_plain_frames(spark):
    values = [(t, None if t % 11 == 0 else 1e9 + (t // 40) % 3 * (t % 7 > 3)) for t in range(0, 900, 3) if not 300 < t < 420]
    df = spark.createDataFrame([("d", t, v) for t, v in values], "ip string, t_secs long, v double")
    got = {r.t_secs: r for r in rolling.rolling_per_second(df, ["v"], [30, 60], ["ip"]).collect()}
    for t, _ in values:
        for w in (30, 60):
            now = [v for s, v in values if t - w <= s <= t and v is not None]
            past = [v for s, v in values if t - 2 * w <= s <= t - w and v is not None]
            mean = sum(now) / len(now) if now else None
            row = got[t]
            assert (row[f"v_avg_{w}"] is None) == (mean is None) and (mean is None or math.isclose(row[f"v_avg_{w}"], mean, rel_tol=1e-12))
            if len(now) < 2:
                assert row[f"v_std_{w}"] is None
            else:
                want = statistics.stdev(now)
                assert row[f"v_std_{w}"] == 0 if len(set(now)) == 1 else math.isclose(row[f"v_std_{w}"], want, rel_tol=1e-5)
            assert (row[f"v_pct_change_{w}"] is None) == (mean is None or not past)


def test_text_vectors_equal_the_weights(spark):
    from pyspark.ml.functions import vector_to_array

    df = spark.createDataFrame([(1, "a b a c"), (2, "b c"), (3, None), (4, "zzz")], "id long, t string")
    vocab = ft.fit_tfidf(df, "id", "t", max_features=4).cache()
    cells = {(r.id, r.term_id): r.weight for r in ft.tfidf(df, "id", "t", vocab).collect()}
    rows = ft.sparse_text(df, "id", "t", vocab, 4).select("id", vector_to_array("text_vec").alias("v")).collect()
    got = {(r.id, i): x for r in rows for i, x in enumerate(r.v) if x}
    assert got.keys() == cells.keys() and all(math.isclose(got[k], cells[k], rel_tol=1e-12) for k in got) and len(rows) == 4


def test_swept_modes_equal_frames(spark):
    rows = [("d", t, None if t % 13 == 0 else "abc"[t * t // 7 % 3]) for t in range(0, 600, 4)]
    df = spark.createDataFrame(rows, "ip string, t_secs long, s string")
    got = rolling.state_mode(df, ["s"], ["ip"], span=60).drop("s")

    def over(lo, hi):
        return F.mode("s", True).over(Window.partitionBy("ip").orderBy("t_secs").rangeBetween(lo, hi))

    want = df.select("ip", "t_secs", over(-60, 0), over(-120, -60))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and got.count() == len(rows)


@pytest.mark.parametrize("ratio", [0, 0.1, 0.25, 0.5, 0.7, 1])
def test_a_split_inside_rows_with_equal_keys(spark, ratio):
    times = [None, None, 1, 1, 1, 1, 1, 2, 2, 3]
    for tie in (None, "k"):
        df = spark.createDataFrame([(i, t, None if i % 3 else 7) for i, t in enumerate(times)], "id long, t long, k long")
        head, rest = (x.collect() for x in filters.ratio_split(df.repartition(3), "t", ratio, tie))
        assert len(head) == int(10 * ratio) and sorted(r.id for r in [*head, *rest]) == list(range(10))
        order = [(r.t or 0, (r.k or 0) if tie else 0) for r in [*head]], [(r.t or 0, (r.k or 0) if tie else 0) for r in rest]
        assert not head or not rest or max(order[0]) <= min(order[1])
    assert [x.count() for x in filters.ratio_split(df.limit(0), "t", 0.5)] == [0, 0]


def test_a_split_numbers_only_the_rows_at_the_boundary(spark, tmp_path):
    df = spark.range(1000).select("id", F.floor(F.col("id") / 10).alias("t"))
    df.write.parquet(str(tmp_path / "t"))
    head, rest = filters.ratio_split(spark.read.parquet(str(tmp_path / "t")), "t", 0.505)
    assert (head.count(), rest.count()) == (505, 495)
    assert "PushedFilters: [Or(IsNull(t),LessThan(t,50))]" in head._jdf.queryExecution().toString()


def test_value_types_of_files_behind_mounts_and_without_scheme(spark, tmp_path):
    spark.createDataFrame([("a",)], "value string").coalesce(1).write.parquet(str(tmp_path / "text"))
    spark.createDataFrame([((1,),)], "value struct<x:int>").coalesce(1).write.parquet(str(tmp_path / "struct"))
    (text,), (struct,) = (list((tmp_path / n).glob("*.parquet")) for n in ("text", "struct"))
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.here.link./in", f"file://{tmp_path}")
    mounted = f"viewfs://here/in/text/{text.name}"
    paths = [str(text), mounted, f"file:{struct}", f"file://{struct}", f"viewfs://here/in/none/{text.name}", f"{tmp_path}/none"]
    found = rd.split_paths_by_value_type(spark, paths)
    assert found["string"] == sorted([str(text), mounted]) and found["struct"] == sorted(paths[2:4])
    assert [p for p, _ in found["error"]] == sorted(paths[4:])


def test_ranges_without_a_counterpart_are_refused_by_name():
    with pytest.raises(ValueError, match="num_leaves.*reg_alpha.*reg_lambda.*subsample_freq"):
        ft.draw_params(1)
    draws = ft.draw_params(50, without=ft.NO_COUNTERPART)
    for name, (kind, low, high, _) in ft.SEARCH_SPACE.items():
        if name not in ft.NO_COUNTERPART:
            values = [float(d[ft.GBT_PARAMS[name]]) for d in draws]
            assert low <= min(values) < max(values) <= high and (kind == "float" or all(v == int(v) for v in values))


def test_a_guided_search_comes_closer_than_random_draws():
    names = ["a", "b", "c"]

    def miss(places):
        return abs(places["a"] - 0.8) + abs(places["b"] - 0.15) + 0.1 * abs(places["c"] - 0.5)

    def best(warm, seed):
        rng, past = random.Random(seed), []
        for _ in range(60):
            places = ft.guided_places(past, names, rng, warm)
            assert all(0 <= v <= 1 for v in places.values())
            past.append((places, -miss(places)))
        return -max(s for _, s in past)

    guided, plain = (statistics.mean(best(warm, seed) for seed in range(20)) for warm in (5, 1000))
    assert guided < 0.6 * plain


def _polls(spark, n):
    from faultline.plans import tabular

    services = [tabular.COMPONENT_SERVICE, tabular.SUBSCRIBER_SERVICE, tabular.TRAFFIC_SERVICE]
    rows = [(str(i), f"d{i % 3}", "Routing Engine" if i % 2 else "FPC: slot @ 0", "et-1",
             '{"cpu":"%d","heap":"%d","temp":"3","state":"%d","jnx_subscriber_active_count":"%d",'
             '"jnx_subscriber_total_count":"9","if_out_octets":"%d","if_in_octets":"x"}' % (i % 7, i % 11, i % 4, i, i % 13),
             f"2024-01-01 {i // 40 % 24:02d}:{i % 40:02d}:00", services[i * 7 // 5 % 3]) for i in range(n)]
    return rd.normalize_schema(spark.createDataFrame(
        [*rows, rows[0]], "job_id string, `ip-address` string, component_name string, if_name string, value string, time string, "
        "service_name string"))


def test_tasks_of_poll_windows_grow_with_the_polls(spark, monkeypatch):
    from faultline.plans import tabular

    devices = spark.createDataFrame([("d0",), ("d1",)], "ip_address string")
    names = ["FPC 0", "Routing Engine 0"]
    few = tabular.poll_windows(_polls(spark, 300), devices, names)
    monkeypatch.setattr(tabular, "CELLS_PER_TASK", 50)
    many = tabular.poll_windows(_polls(spark, 300), devices, names)
    assert few.columns == many.columns
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    # 100 or 101 polls a service, of 6, 2 and 2 numbers
    assert many.rdd.getNumPartitions() >= 12 + 8 + 8 and few.rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism


def test_rows_that_are_sorted_are_narrow(spark):
    polls = spark.createDataFrame([("d", 1, "a.b", "5", None, "2"), ("d", 1, "a.b", "6", "x", "1"), ("d", 1, "c", "7", "y", None),
                                   ("d", 2, "c", "8", "z", "1")],
                                  "ip string, t int, component string, cpu string, state string, job_id string")
    wide = agg.pivot_components(polls, ["ip", "t"], "component", ["cpu", "state"], ["a.b", "c"])
    assert wide.columns == ["ip", "t", "a.b_cpu", "a.b_state", "c_cpu", "c_state"]
    assert sorted(map(tuple, wide.collect())) == [("d", 1, "6", "x", None, None), ("d", 2, None, None, "8", "z")]
    assert wide._jdf.queryExecution().optimizedPlan().toString().count("min_by(") == 2  # one a component

    rows = spark.createDataFrame([("d", 1, "b", 1.0), ("d", 1, "b", 2.0), ("d", 0, "z", 9.0)], "ip string, t int, s string, v double")
    last = agg.last_row_per_window(rows, ["ip"], "t", ["s", "v"])
    assert [r.asDict() for r in last.collect()] == [{"ip": "d", "t": 1, "s": "b", "v": 2.0}]
    assert "max_by" not in last._jdf.queryExecution().optimizedPlan().toString()

    a = spark.createDataFrame([(1, None, 5), (2, "a", None)], "k int, x string, `y.z` int")
    b = spark.createDataFrame([(1, "b", 6), (3, "c", None)], "k int, x string, w int")
    one, other = agg.first_non_null_merge([a, b], ["k"]), agg.first_non_null_merge([a, b], ["k"], single=True, tasks=3)
    assert one.schema.simpleString() == other.schema.simpleString()
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))


@pytest.mark.parametrize("name", ["f5_guided_search", "f5_tune_time_holdout"])
def test_search_queries_draw_from_the_whole_ranges(spark, monkeypatch, name):
    """Every trial and the refit train as many trees as drawn from the full ranges; the stub keeps them small here."""
    import __spark_entry__ as entry
    from faultline.plans import q_evaluate

    start, asked, fit = dt.datetime(2024, 1, 1), [], ft.fit_classifier
    rows = spark.createDataFrame([(i, start + dt.timedelta(hours=6 * i), float(i % 7), i % 2) for i in range(80)],
                                 "row long, window_5min_end timestamp, n double, label int")
    rows = ft.Prepared(rows, "row", ["n"]).transform(rows)

    def few(prepared, label="label", weight=None, seed=42, **params):
        asked.append(params)
        return fit(prepared, label, seed=seed, maxIter=1, maxDepth=2)

    monkeypatch.setattr(q_evaluate, "_prepared", lambda *_: (None, None, rows))
    monkeypatch.setattr(ft, "fit_classifier", few)
    assert entry.queries()[name](spark, "").count() == 1
    trials = asked[:-1]  # the last is the refit
    assert len(trials) == 10 and asked[-1] in trials
    trees, depths = [p["maxIter"] for p in trials], [p["maxDepth"] for p in trials]
    assert 200 <= min(trees) and 1000 < max(trees) <= 2000 and 3 <= min(depths) and 8 < max(depths) <= 12
