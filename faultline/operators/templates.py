"""Log templates: mining, matching, catalogue (M1, M7, M8, M10-M12, J4) and their statistics.

Mining depends on the order of the lines of a shard. Lines of a shard are ranked and cut into bounded chunks. In a round,
one task per shard, the lead, runs several chunks one after the other from the known state, and other tasks try later chunks
from that same state. Every run notes which leaves it looked at and which it changed. A try is worth as much as a run in order
if no earlier one of the round changed what it looked at; the changes of all such runs, which are of different leaves, are put
together, and mining goes on behind the first try that is not. So rounds grow with the conflicts on a leaf, not with the
number of changes. Where tries do not count, the lead doubles from round to round up to ``LEAD`` chunks of full size, so small
chunks do not make many rounds. Chunks lie in folders by their number, so finished ones are not read again. A shard that holds a third of
all lines is thus never one task; where all shards are one chunk, lines are neither ranked nor written before.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.clock import quoted
from faultline.operators.mining_core import Footprint, MinerConfig, Shard
from faultline.operators.order import global_rank
from faultline.session import discard, fresh_dir, stored, tidy_shuffles

CHUNK_TOKENS = 2_000_000  # tokens of one chunk
CHUNK_LINES = 50_000  # lines of one chunk
LEAD = 8  # chunks that the first task of a shard takes while the state keeps changing
MAX_SPAN = 1024  # chunks of one shard tried in one round behind the first task's
BAND = 16  # chunks in a folder
PACK = 500  # lines of a first word that shares a task's group with others
PACKED = 20_000  # lines of such a group
SEP = "\x1f"  # between the tokens of a message on its way to a task; white space, so no token has it
ID_BITS = 32
FORGOTTEN = -1  # ``tree_ord`` of the catalogue row that counts a shard's lines of forgotten clusters

STATE = ("shard string, local_id bigint, tokens array<string>, leaf_path string, tree_ord bigint, touched bigint, "
         "next_id bigint")
STEP_OUT = ("kind string, shard string, chunk bigint, pos bigint, change_type string, template_mined string, "
            "seen bigint, ts bigint, local_id bigint, tokens array<string>, leaf_path string, tree_ord bigint, "
            "touched bigint, next_id bigint, reads array<string>, writes array<string>, nodes array<string>, "
            "opened array<bigint>, created bigint, evicted boolean")
#: What the runs of a round come to: the chunks that count, how far their new ids move up, or a row of the new state.
JUDGED = STATE + ", kind string, base bigint, accepted array<bigint>, shifts array<bigint>"
CATALOG = STATE + ", size bigint, latest_ts bigint"


def shard_of(tokens: Column, engine: str = "length") -> Column:
    """Shard name: token count, or the first token ("" for an empty line)."""
    if engine == "jaccard":
        return F.coalesce(F.try_element_at(tokens, F.lit(1)), F.lit(""))
    return F.size(tokens).cast("string")


def _arrow_type(schema: str | T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)


@lru_cache(maxsize=256)
def _nulls(n: int, kind: pa.DataType) -> pa.ChunkedArray:
    return pa.chunked_array([pa.nulls(n, kind)])


def _table(columns: dict, n: int, want: pa.Schema) -> pa.Table:
    """The columns in the shape of ``want``; lacking ones are null."""
    return pa.table([(_nulls if n < 100 else _nulls.__wrapped__)(n, f.type) if f.name not in columns else
                     columns[f.name].cast(f.type) if isinstance(columns[f.name], (pa.Array, pa.ChunkedArray)) else
                     pa.array(columns[f.name], f.type) for f in want], schema=want)


def settle(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written to a folder and read again, and the folder, to be deleted when nothing reads it any more."""
    path = fresh_dir(df.sparkSession, "mining-round")
    return stored(df, path), path


def _step(cfg: MinerConfig, keys: Sequence[str], want: pa.Schema, lone: bool):
    """One run of chunks of one shard, fed in order from the handed-over state; named by its first chunk.

    Lines without ``pos`` are all lines of their shard and are put in order here. A ``lone`` run, the only one of its shard in
    the round, hands on the whole state; others hand on the leaves they changed. A group may hold several small shards.
    """

    def run(key, lines: pa.Table, state: pa.Table) -> pa.Table:
        known: dict[str, list[dict]] = {}
        for r in state.to_pylist():
            known.setdefault(r["shard"], []).append(r)
        lines, at, parts = lines.sort_by("shard").combine_chunks(), 0, []
        for name, n in ((x["values"], x["counts"]) for x in lines["shard"].value_counts().to_pylist()):
            parts += one(name, key[1].as_py(), lines.slice(at, n), known.get(name, []))
            at += n
        return pa.concat_tables(parts).combine_chunks()

    def one(name: str, chunk: int, lines: pa.Table, state: list[dict]) -> list[pa.Table]:
        shard = Shard(cfg, state)
        if lines["pos"].null_count:
            lines = lines.take(pc.sort_indices(lines, [(k, "ascending") for k in keys], null_placement="at_start"))
            lines = lines.set_column(lines.schema.get_field_index("pos"), "pos", pa.array(range(len(lines)), pa.int64()))
        else:
            lines = lines.sort_by("pos")
        change, local, shown, seen, latest = [], [], [], [], []
        count: dict[int, int] = {}
        newest: dict[int, int] = {}
        created = []
        for text, pos, ts in zip(lines["text"], lines["pos"].to_pylist(), lines["ts"].to_pylist()):
            text = text.as_py()
            kind, cid = shard.add(text.split(" ") if text else [], pos)
            count[cid] = count.get(cid, 0) + 1
            newest[cid] = max(newest.get(cid, ts), ts)
            change.append(kind)
            local.append(cid)
            shown.append(shard.text(cid))
            seen.append(count[cid])
            latest.append(newest[cid])
            created.append(shard.next_id)
        n, made = len(local), shard.footprint()
        named = {"shard": name, "chunk": chunk}
        parts = [_table({"kind": ["line"] * n, "pos": lines["pos"], "change_type": change, "template_mined": shown,
                         "seen": seen, "ts": latest, "local_id": local, "next_id": created,
                         **{k: [v] * n for k, v in named.items()}, **{k: lines[k] for k in keys}}, n, want),
                 _table({"kind": ["chunk"], "reads": [sorted(made.reads)], "writes": [sorted(made.writes)],
                         "nodes": [list(made.opened)], "opened": [list(made.opened.values())], "created": [made.created],
                         "evicted": [made.evicted], **{k: [v] for k, v in named.items()}}, 1, want)]
        if made.writes:
            left = [r for r in shard.rows() if lone or "L " + r["leaf_path"] in made.writes]
            parts.append(_table({"kind": ["state"] * len(left), **{k: [v] * len(left) for k, v in named.items()},
                                 **{c: [r[c] for r in left] for c in left[0]}}, len(left), want))
        return parts

    return run


def _judge(cfg: MinerConfig, want: pa.Schema):
    """The runs of a shard's round, in order: which count, and the state behind the last of them."""

    def run(key, runs: pa.Table, state: pa.Table) -> pa.Table:
        name = key[0].as_py()
        shard = Shard(cfg, state.to_pylist())
        base, shift, accepted, shifts = shard.next_id, 0, [], []
        changed: set[str] = set()
        opened: dict[str, int] = {}
        chunks = sorted(runs.filter(pc.equal(runs["kind"], "chunk")).to_pylist(), key=lambda r: r["chunk"])
        for r in chunks:
            made = Footprint(set(r["reads"]), set(r["writes"]), dict(zip(r["nodes"], r["opened"])), r["created"], r["evicted"])
            if accepted and not shard.allows(made, changed, opened):
                break
            accepted.append(r["chunk"])
            shifts.append(shift)
            if made.writes:
                left = runs.filter(pc.and_(pc.equal(runs["kind"], "state"), pc.equal(runs["chunk"], r["chunk"])))
                shard.take_over(sorted(left.to_pylist(), key=lambda x: x["tree_ord"]), base, shift, made.created)
            changed |= made.writes
            for node, n in made.opened.items():
                opened[node] = opened.get(node, 0) + n
            shift += made.created
        parts = [_table({"kind": ["runs"], "shard": [name], "base": [base], "accepted": [accepted], "shifts": [shifts]}, 1, want)]
        if changed:
            rows = list(shard.rows())
            parts.append(_table({"kind": ["state"] * len(rows), "shard": [name] * len(rows),
                                 **{c: [r[c] for r in rows] for c in rows[0]}}, len(rows), want))
        return pa.concat_tables(parts)

    return run


def _mine(df: DataFrame, text: Column, tokens: Column, ts: Column, order_by: Sequence[str], cfg: MinerConfig,
          initial: DataFrame | None, chunk_tokens: int, lead: int | None) -> tuple[DataFrame, DataFrame]:
    spark = df.sparkSession
    done_path = fresh_dir(spark, "mined-lines")
    keys = [f"_key{i}" for i in range(len(order_by))]
    lines = df.select(*[F.col(quoted(o)).alias(k) for o, k in zip(order_by, keys)],
                      shard_of(tokens, cfg.engine).alias("shard"), text.alias("text"),
                      F.size(tokens).alias("_len"), ts.cast("bigint").alias("ts"))
    # the lines are read several times, but cut into tokens once
    lines_path = fresh_dir(spark, "mining-lines")
    lines = stored(lines, lines_path)
    out_schema = T.StructType([*T.StructType.fromDDL(STEP_OUT), *[T.StructField(k, lines.schema[k].dataType) for k in keys]])
    judge = _judge(cfg, _arrow_type(JUDGED))
    per_chunk = F.least(F.greatest(F.floor(F.lit(chunk_tokens) / F.greatest("_longest", F.lit(1))), F.lit(1)), F.lit(CHUNK_LINES))
    # a given lead is kept; else it grows while tries do not count, up to the tokens of LEAD full chunks
    most = lead or max(LEAD, LEAD * CHUNK_TOKENS // chunk_tokens)
    lead = lead or LEAD
    # one row per shard: token counts are no more than the longest line is long; first words may be many
    few = F.broadcast if cfg.engine == "length" else (lambda d: d)
    shards, shards_path = settle(lines.groupBy("shard").agg(F.count("*").alias("_lines"), F.max("_len").alias("_longest"))
                    .select("shard", "_lines", per_chunk.alias("_per"), F.floor((F.col("_lines") - 1) / per_chunk).alias("last")))
    whole = not shards.filter("last > 0").head(1)
    if whole:
        rows = lines.drop("_len").withColumns({c: F.lit(v).cast("bigint") for c, v in (("pos", None), ("chunk", 0), ("band", 0))})
    else:
        rows_path, laid_path = fresh_dir(spark, "mining-rows"), fresh_dir(spark, "mining-laid")
        ranked = global_rank(lines.drop("_len"), keys, by=["shard"], name="pos", keep=lambda d: stored(d, laid_path),
                             few=cfg.engine == "length").join(few(shards.drop("_lines")), "shard")
        discard(spark, lines_path)
        rows = stored(ranked.withColumn("chunk", F.floor(F.col("pos") / F.col("_per"))).withColumn(
            "band", F.floor(F.col("chunk") / BAND)).drop("_per", "last"), rows_path, "band")
        discard(spark, laid_path)

    if initial is None:
        state = spark.createDataFrame([], STATE)
    else:
        # lines of this run come after everything the catalogue has seen; a shard's catalogue is small
        age = F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("touched"), F.desc("local_id")))
        state = (initial.filter(F.col("tree_ord") > FORGOTTEN).select(*[f.name for f in T.StructType.fromDDL(STATE)])
                 .withColumn("touched", -age.cast("bigint")))
    # small shards of first words, which may be many, go to a task's function together
    group, small = F.concat(F.lit("="), "shard"), (F.col("last") == 0) & (F.col("_lines") <= PACK)
    if cfg.engine != "length":
        packs = (shards.filter(small).agg(F.sum("_lines")).first()[0] or 0) // PACKED + spark.sparkContext.defaultParallelism
        group = F.when(small, F.pmod(F.xxhash64("shard"), F.lit(packs)).cast("string")).otherwise(group)
    progress = shards.select("shard", group.alias("_group"), F.lit(0).cast("bigint").alias("nxt"), "last", F.lit(0).cast("bigint").alias("span"),
                             F.lit(lead).cast("bigint").alias("lead"), F.lit(lead).cast("bigint").alias("grown"))
    lines_type = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out_schema
                           if f.name in ("shard", "chunk", "pos", "change_type", "template_mined", "seen", "ts", "local_id"))
    lines_type += ", created bigint, " + ", ".join(f"{k} {lines.schema[k].dataType.simpleString()}" for k in keys)
    names = [f.name for f in T.StructType.fromDDL(STATE)]
    rounds, low, high = 0, 0, (lead - 1) // BAND
    state_path, held = fresh_dir(spark, "mined-state"), [shards_path]
    if initial is not None and not whole:  # shards of the catalogue without new lines
        state.join(few(shards.select("shard")), "shard", "left_anti").write.option("compression", "zstd").mode("append").parquet(state_path)
        state = state.join(few(shards.select("shard")), "shard", "left_semi")
    while True:
        window = progress.withColumns({"stop": F.least("last", F.col("nxt") + F.col("lead") + F.col("span") - 1),
                                       "behind": F.least(F.col("last") + 1, F.col("nxt") + F.col("lead"))})
        shape = few(window.select("shard", "_group", "nxt", "stop", "behind"))
        todo = rows.filter(F.col("band").between(low, high)).join(shape, "shard").filter(
            F.col("chunk").between(F.col("nxt"), F.col("stop"))).withColumn(
            "chunk", F.when(F.col("chunk") < F.col("behind"), F.col("nxt")).otherwise(F.col("chunk"))).select(
            "shard", "_group", "chunk", "pos", "text", "ts", *keys)
        tries = F.when(F.col("behind") <= F.col("stop"), F.sequence("behind", "stop")).otherwise(F.array().cast("array<bigint>"))
        starts = state.join(shape.withColumnRenamed("_group", "_g"), "shard").withColumn("_group", F.concat("_g", F.lit(""))).withColumn(
            "chunk", F.explode(F.concat(F.array("nxt"), tries))).drop("nxt", "stop", "behind", "_g")
        out, out_path = settle(todo.groupBy("_group", "chunk").cogroup(starts.groupBy("_group", "chunk"))
                               .applyInArrow(_step(cfg, keys, _arrow_type(out_schema), lone=rounds == 0), out_schema))
        passed = [out_path]  # folders that the next round does not read
        if rounds:
            judged, judged_path = settle(out.filter("kind <> 'line'").drop(*keys).groupBy("shard").cogroup(state.groupBy("shard"))
                                         .applyInArrow(judge, T.StructType.fromDDL(JUDGED)))
            passed.append(judged_path)
        else:  # lead runs only: what they leave is the state
            judged = out.withColumns({"kind": F.when(F.col("kind") == "chunk", "runs").otherwise(F.col("kind")),
                                      "base": F.lit(0).cast("bigint"), "accepted": F.array("chunk"),
                                      "shifts": F.array(F.lit(0).cast("bigint"))})
        verdict = judged.filter("kind = 'runs'").select("shard", "base", F.map_from_arrays("accepted", "shifts").alias("_shifts"),
                                                        F.array_max("accepted").alias("_upto"))
        kept = out.filter("kind = 'line'")
        if rounds:  # a first run always counts, and its ids stay
            kept = kept.join(few(verdict), "shard").withColumn("_shift", F.col("_shifts")[F.col("chunk")]).filter("_shift IS NOT NULL")
        else:
            kept = kept.withColumns({"base": F.lit(0).cast("bigint"), "_shift": F.lit(0).cast("bigint")})
        fed = kept.select(
            "shard", "chunk", "pos", "change_type", "template_mined", "seen", "ts",
            (F.col("local_id") + F.when(F.col("local_id") > F.col("base"), F.col("_shift")).otherwise(0)).alias("local_id"),
            (F.col("next_id") + F.col("_shift")).alias("created"), *keys)
        if not whole:
            fed.write.option("compression", "zstd").mode("append").parquet(done_path)
        rounds += 1
        moved = judged.filter("kind = 'state'").select(*names)
        if rounds == 1 and initial is None:  # first runs know when each cluster was touched
            state = moved
        else:
            still = state.join(moved.select("shard").distinct(), "shard", "left_anti")
            touch = fed.groupBy("shard", "local_id").agg(F.max("pos").alias("_pos"))
            state = (moved.unionByName(still.select(*names)).join(touch, ["shard", "local_id"], "left")
                     .withColumn("touched", F.greatest("touched", F.coalesce("_pos", "touched"))).select(*names))
        if whole:
            # the runs hold lines and state; only a state with a past has more
            state = state if initial is None else stored(state, state_path)
            for path in (lines_path, *held):
                discard(spark, path)
            break
        # the lead run stands for all chunks before ``behind``
        judged_at = window.join(verdict, "shard").withColumn("upto", F.when(
            F.col("_upto") == F.col("nxt"), F.col("behind") - 1).otherwise(F.col("_upto")))
        calm = F.col("upto") == F.col("stop")
        wide = F.when(calm, F.greatest(F.col("span"), F.lit(1)) * 4).otherwise(
            F.greatest((F.col("upto") - F.col("behind") + 1) * 2, F.lit(1)))
        grown = F.when(calm & (F.col("span") > 0), F.col("grown")).otherwise(F.least(F.col("grown") * 2, F.lit(most))).cast("bigint")
        progress, progress_path = settle(judged_at.select(
            "shard", "_group", (F.col("upto") + 1).alias("nxt"), "last", F.least(wide, F.lit(MAX_SPAN)).cast("bigint").alias("span"),
            F.when(calm, F.lit(1)).otherwise(grown).cast("bigint").alias("lead"),
            grown.alias("grown")).filter(F.col("nxt") <= F.col("last")))
        reach = progress.agg(F.min("nxt").alias("low"), F.max(F.col("nxt") + F.col("lead") + F.col("span") - 1).alias("high")).first()
        # shards that are done leave the loop
        state.join(few(progress.select("shard")), "shard", "left_anti").write.option("compression", "zstd").mode("append").parquet(state_path)
        passed, held = [*passed, *held], [progress_path]
        if reach["low"] is not None:
            low, high = reach["low"] // BAND, reach["high"] // BAND
            state, path = settle(state.join(few(progress.select("shard")), "shard", "left_semi"))
            held.append(path)
        else:
            passed += [rows_path, progress_path]
        for path in passed:
            discard(spark, path)
        if reach["low"] is None:
            state = spark.read.schema(STATE).parquet(state_path)
            break
    # one round without a past: every shard was a single task, and what it saw are the totals
    done = (fed if whole else spark.read.schema(lines_type).parquet(done_path)).withColumnsRenamed(dict(zip(keys, order_by)))
    return _with_totals(done, state, initial, order_by, alone=rounds == 1 and initial is None)


def _with_totals(done: DataFrame, state: DataFrame, initial: DataFrame | None, order_by: Sequence[str],
                 alone: bool) -> tuple[DataFrame, DataFrame]:
    """Add up what each chunk saw: running sizes and times of the lines, totals of the catalogue."""
    pieces = done.groupBy("shard", "local_id", "chunk").agg(F.max("seen").alias("n"), F.max("ts").alias("t"))
    if initial is not None:
        base = initial.filter("local_id is not null").select(
            "shard", "local_id", F.lit(-1).cast("bigint").alias("chunk"), F.col("size").alias("n"),
            F.col("latest_ts").alias("t"))
        pieces = pieces.unionByName(base)
    if alone:
        lines = done.withColumns({"_n": F.lit(0).cast("bigint"), "_t": F.col("ts")})
    else:
        # one row per cluster and chunk
        ahead = Window.partitionBy("shard", "local_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        carried = pieces.withColumns({"_n": F.coalesce(F.sum("n").over(ahead), F.lit(0)), "_t": F.max("t").over(ahead)})
        lines = done.join(carried.drop("n", "t"), ["shard", "local_id", "chunk"])
    lines = lines.select(*map(quoted, order_by), "shard", "local_id", "change_type",
                         (F.col("_n") + F.col("seen")).alias("cluster_size"), "template_mined",
                         F.col("created").alias("shard_cluster_count"), F.greatest("_t", "ts").alias("latest_ts"))
    totals = pieces.groupBy("shard", "local_id").agg(F.sum("n").alias("size"), F.max("t").alias("latest_ts"))
    gone = totals.join(state.select("shard", "local_id"), ["shard", "local_id"], "left_anti")
    if initial is not None:
        gone = gone.unionByName(initial.filter(F.col("tree_ord") == FORGOTTEN).select("shard", "local_id", "size", "latest_ts"))
    gone = gone.groupBy("shard").agg(F.sum("size").alias("size"), F.max("latest_ts").alias("latest_ts"))
    row = {"local_id": None, "tokens": None, "leaf_path": "", "tree_ord": FORGOTTEN, "touched": -1, "next_id": 0}
    gone = gone.withColumns({c: F.lit(v).cast(state.schema[c].dataType) for c, v in row.items()})
    return lines, state.join(totals, ["shard", "local_id"], "left").unionByName(gone)


def global_id(shard: str = "shard", local: str = "local_id") -> Column:
    """M1e: token count in the high bits, the shard's own counter in the low ones."""
    return F.shiftleft(F.col(shard).cast("bigint"), ID_BITS) + F.col(local)


def mine_templates(df: DataFrame, tokens: str, order_by: Sequence[str], cfg: MinerConfig = MinerConfig(),
                   ts: str | Column | None = None, initial: DataFrame | None = None,
                   chunk_tokens: int = CHUNK_TOKENS, lead: int | None = None) -> tuple[DataFrame, DataFrame]:
    """M1: (result per line, catalogue). Lines are fed per token count in the order of the unique ``order_by``.

    ``initial`` goes on from a saved catalogue. Where the cap made a shard forget clusters, the catalogue has one more row for it
    (no ``local_id``, ``tree_ord`` ``FORGOTTEN``) whose ``size`` is the number of their lines, so sizes add up. ``shard_cluster_count`` counts the clusters made in the line's shard
    so far; the total over all shards is in :func:`cluster_stats`.
    """
    t = F.col(quoted(tokens))
    stamp = F.lit(0) if ts is None else (F.col(quoted(ts)) if isinstance(ts, str) else ts)
    with tidy_shuffles(df.sparkSession):
        lines, catalog = _mine(df, F.array_join(t, " "), t, stamp, order_by, cfg, initial, chunk_tokens, lead)
    if cfg.engine == "length":
        lines = lines.withColumn("cluster_id", global_id())
        catalog = catalog.withColumn("cluster_id", global_id())
    else:
        both = F.concat_ws("#", "shard", F.col("local_id").cast("string"))
        lines, catalog = lines.withColumn("cluster_id", both), catalog.withColumn("cluster_id", both)
    return lines, catalog


def mine_templates_jaccard(df: DataFrame, tokens: str, order_by: Sequence[str],
                           cfg: MinerConfig = MinerConfig(engine="jaccard"), **more) -> tuple[DataFrame, DataFrame]:
    """M8: like M1 with shards by first token and set similarity; lines of unequal length may merge."""
    if cfg.engine != "jaccard":
        raise ValueError("needs engine='jaccard'")
    return mine_templates(df, tokens, order_by, cfg, **more)


def assign_templates(df: DataFrame, lines: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """The rows with their cluster and the template at that moment."""
    return df.join(lines.select(*map(quoted, order_by), "cluster_id", "template_mined"), list(order_by), "left")


def save_catalog(catalog: DataFrame, path: str) -> None:
    """Keep the catalogue as a table."""
    catalog.write.option("compression", "zstd").mode("overwrite").parquet(path)


def load_catalog(spark, path: str) -> DataFrame:
    """Read it back; pass it on as ``initial``."""
    return spark.read.parquet(path)


def release(*results: DataFrame) -> None:
    """Delete what mining keeps for its results, once they are written elsewhere and not read again."""
    folders = {f.rsplit("/", 1)[0] for df in results for f in df.inputFiles()}
    for folder in folders:
        if folder.rsplit("/", 1)[1].startswith(("mining-round-", "mined-lines-", "mined-state-")):
            discard(results[0].sparkSession, folder)


# -- matching -----------------------------------------------------------------------------------------------------


def live_templates(catalog: DataFrame) -> DataFrame:
    return catalog.filter("local_id is not null")


def ended_templates(lines: DataFrame, catalog: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """(cluster_id, template) of the clusters that the cap made the miner forget: the template after their last line.

    Lines of shards that forgot nothing stay where they are: the catalogue names the others.
    """
    some = catalog.filter(F.col("tree_ord") == FORGOTTEN).select("shard").distinct()
    if catalog.schema["cluster_id"].dataType == T.LongType():
        some = F.broadcast(some)  # one row per token count
    gone = lines.join(some, "shard", "left_semi").join(live_templates(catalog).select("cluster_id"), "cluster_id", "left_anti")
    return gone.groupBy("cluster_id").agg(F.max_by("template_mined", F.struct(*map(quoted, order_by))).alias("template"))


def _perfect(cfg: MinerConfig, strategy: str, fewest_wildcards: bool, kept: Sequence[str], want: pa.Schema):
    """Perfect matches of one piece of a shard's messages, against all templates of the shard.

    A template is listed under its rarest literal, so a message looks at few of them, whatever their number. Repeated messages
    are looked up once.
    """
    param = cfg.param

    def run(lines: pa.Table, state: pa.Table) -> pa.Table:
        rows = state.to_pylist()
        for r in rows:
            r["tokens"] = _cut(r["text"], r["n"])
        often = Counter((i, t) for r in rows for i, t in enumerate(r["tokens"] or ()) if t != param)
        kids: dict[tuple, set[str]] = {}
        lists: dict[tuple[int, str], list] = {}
        loose = []
        for r in rows:
            path = tuple(r["leaf_path"].split(" ")) if r["leaf_path"] else ()
            for i in range(len(path)):
                kids.setdefault(path[:i], set()).add(path[i])
            if r["local_id"] is None:
                continue
            literal = [(i, t) for i, t in enumerate(r["tokens"]) if t != param]
            wild = len(r["tokens"]) - len(literal)
            entry = (path, -wild if fewest_wildcards else wild, -r["tree_ord"], literal, r["local_id"], r["tokens"], r["log_key"])
            (lists.setdefault(min(literal, key=often.__getitem__), []) if literal else loose).append(entry)

        def route(words: list[str]) -> tuple | None:
            path: tuple = ()
            for t in cfg.path_tokens(words):
                under = kids.get(path, ())
                if t not in under and param not in under:
                    return None
                path += (t if t in under else param,)
            return path

        def best(words: list[str] | None):
            if words is None:
                return None
            leaf = None if strategy == "always" else route(words)
            top = rank = None
            for found in (loose, *(lists.get(x, ()) for x in enumerate(words))):
                for e in found:
                    here = strategy == "always" or e[0] == leaf
                    if (here or strategy != "never") and all(words[i] == t for i, t in e[3]):
                        mine = (here, e[1], e[2])
                        if rank is None or mine > rank:
                            top, rank = e, mine
            return top

        seen: dict[str, tuple | None] = {}
        hits = []
        for text, n in zip(lines["_text"], lines["_len"].to_pylist()):
            text = text.as_py()
            if text not in seen:
                seen[text] = best(_cut(text, n)) if rows else None
            hits.append(seen[text])
        shown = {id(e): " ".join(e[5]) for e in seen.values() if e is not None}
        return _table({**{c: lines[c] for c in kept}, "_text": lines["_text"], "_len": lines["_len"],
                       "template": [None if e is None else shown[id(e)] for e in hits],
                       "_local": [None if e is None else e[4] for e in hits],
                       "log_key": [None if e is None else e[6] for e in hits]}, len(lines), want)

    return run


def _joined(tokens: Column) -> Column:
    """A list of tokens as one text, which is half as large on its way as a list."""
    return F.array_join(tokens, SEP)


def _lists(text: str, n: str) -> Column:
    """The lists that :func:`_joined` made, of ``n`` tokens each."""
    return F.when(F.col(n) == 0, F.array().cast("array<string>")).otherwise(F.split(text, SEP, -1))


def _stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    return stored(df, fresh_dir(df.sparkSession, label))


def _cut(text: str | None, n: int) -> list[str] | None:
    """The tokens of :func:`_joined`."""
    if text is None:
        return None
    words = text.split(SEP) if n else []
    if len(words) != n:
        raise ValueError(f"a token is null or holds U+001F: {text[:200]!r}")
    return words


def _matched(df: DataFrame, tokens: str, catalog: DataFrame, strategy: str, cfg: MinerConfig, fewest_wildcards: bool,
             tokens_per_task: int) -> DataFrame:
    """All rows with ``template``, ``cluster_id`` and, if the catalogue has it, ``log_key`` of the perfect match, or nulls.

    Rows of a token count are cut into pieces of bounded size, each with the templates of that length: a row travels once,
    with all that it has, and nothing is joined back.
    """
    if strategy not in ("never", "fallback", "always"):
        raise ValueError("strategy must be never, fallback or always")
    t = F.col(quoted(tokens))
    kept = [c for c in df.columns if c != tokens]
    plain = [F.col(quoted(f.name)) for f in df.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    keyed = df.withColumns({"_len": F.coalesce(F.size(t), F.lit(-1)), "_text": _joined(t)})
    pieces = keyed.groupBy("_len").agg(F.greatest(F.ceil(F.sum("_len") / tokens_per_task), F.lit(1)).alias("_n"))
    # one row per token count
    rows = keyed.join(F.broadcast(pieces), "_len").withColumn("_piece", F.pmod(F.xxhash64(*plain), F.col("_n"))).select(
        *map(quoted, kept), "_text", "_len", "_piece")
    known = "log_key" in catalog.columns
    entries = catalog.select(F.col("shard").cast("int").alias("_len"), "local_id", _joined(F.col("tokens")).alias("text"),
                             F.size("tokens").alias("n"), "leaf_path", "tree_ord",
                             (F.col("log_key") if known else F.lit(None)).cast("bigint").alias("log_key")).join(
        F.broadcast(pieces.select("_len", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("_piece"))), "_len")
    schema = T.StructType([*[df.schema[c] for c in kept], *T.StructType.fromDDL(
        "_text string, _len int, template string, _local bigint, log_key bigint")])
    run = _perfect(cfg, strategy, fewest_wildcards, kept, _arrow_type(schema))
    found = rows.groupBy("_len", "_piece").cogroup(entries.groupBy("_len", "_piece")).applyInArrow(run, schema)
    return found.select(_lists("_text", "_len").alias(tokens), *map(quoted, kept), "template",
                        (F.shiftleft(F.col("_len").cast("bigint"), ID_BITS) + F.col("_local")).alias("cluster_id"),
                        *(["log_key"] if known else []))


def match_templates(msgs: DataFrame, catalog: DataFrame, strategy: str = "never", cfg: MinerConfig = MinerConfig(),
                    fewest_wildcards: bool = False, tokens_per_task: int = CHUNK_TOKENS) -> DataFrame:
    """M7: perfect match of the distinct token lists in ``msgs.tokens`` against the catalogue, which stays as it is.

    Ties: most wildcards (or fewest), then tree order. ``never`` looks in the routed leaf only, ``fallback`` elsewhere if that
    finds nothing, ``always`` everywhere.
    """
    columns = [c for c in catalog.columns if c != "log_key"]
    return _matched(msgs.select("tokens").distinct(), "tokens", catalog.select(*map(quoted, columns)), strategy, cfg,
                    fewest_wildcards, tokens_per_task).filter("cluster_id IS NOT NULL")


def map_templates(df: DataFrame, tokens: str, catalog: DataFrame, strategy: str = "never",
                  cfg: MinerConfig = MinerConfig(), vocab: DataFrame | None = None,
                  tokens_per_task: int = CHUNK_TOKENS) -> DataFrame:
    """Every row with the ``template`` and ``cluster_id`` that M7 gives its tokens.

    With a vocabulary of templates rows also get ``log_key`` (J5), 1 where nothing matched. All columns of ``df`` travel, so
    leave out what is not needed.
    """
    state = catalog.select("shard", "local_id", "tokens", "leaf_path", "tree_ord")
    if vocab is not None:
        from faultline.operators.joins import lookup_vocab

        state = lookup_vocab(state.withColumn("_template", F.array_join("tokens", " ")), vocab, "_template", out="log_key")
    out = _matched(df, tokens, state, strategy, cfg, False, tokens_per_task)
    return out if vocab is None else out.withColumn("log_key", F.coalesce("log_key", F.lit(1)))


def match_templates_jaccard(msgs: DataFrame, catalog: DataFrame, cfg: MinerConfig = MinerConfig(engine="jaccard"),
                            threshold: float = 0.8, lines_per_task: int = 200_000, strategy: str = "never") -> DataFrame:
    """M8 matching: best cluster with score >= ``threshold``; nothing is changed.

    ``never`` looks in the routed leaf, ``fallback`` among all clusters of the first word if that finds nothing, ``always``
    among all of them.

    Busy first words are cut into pieces of bounded size, each with its shard's templates.
    """
    distinct = msgs.select("tokens").distinct().withColumn("shard", shard_of(F.col("tokens"), "jaccard"))
    pieces = distinct.groupBy("shard").agg(F.ceil(F.count("*") / lines_per_task).alias("_n"))
    rows = distinct.join(pieces, "shard").withColumn("chunk", F.pmod(F.xxhash64("tokens"), F.col("_n")))
    starts = catalog.select(*[f.name for f in T.StructType.fromDDL(STATE)]).join(
        pieces.select("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("chunk")), "shard")
    schema = "text string, local_id bigint, template string"
    want = _arrow_type(schema)
    if strategy not in ("never", "fallback", "always"):
        raise ValueError("strategy must be never, fallback or always")

    def run(key, lines: pa.Table, state: pa.Table) -> pa.Table:
        shard = Shard(cfg, state.to_pylist())

        def best(w: list[str]) -> int | None:
            found = None if strategy == "always" else shard.best(shard.route(w), w, threshold, True)
            return shard.best_anywhere(w, threshold) if found is None and strategy != "never" else found

        texts = lines["text"].to_pylist()
        words = [t.split(" ") if t else [] for t in texts]
        ids = [best(w) for w in words]
        shown = [None if c is None else shard.text(c) for c in ids]
        return pa.table([pa.array(texts, pa.string()), pa.array(ids, pa.int64()), pa.array(shown, pa.string())],
                        schema=want)

    out = (rows.select("shard", "chunk", F.array_join("tokens", " ").alias("text")).groupBy("shard", "chunk")
           .cogroup(starts.groupBy("shard", "chunk")).applyInArrow(run, schema))
    words = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", " "))
    return out.filter("local_id is not null").withColumn("tokens", words).withColumn(
        "cluster_id", F.concat_ws("#", shard_of(F.col("tokens"), "jaccard"), F.col("local_id").cast("string"))).drop("text")


def mine_templates_distinct(df: DataFrame, tokens: str, order_by: Sequence[str],
                            cfg: MinerConfig = MinerConfig()) -> tuple[DataFrame, DataFrame]:
    """Mine each distinct line once, in order of first sight, then match all rows.

    An approximation of M1 (repeats cannot change a template again). Catalogue sizes count rows. A line that fits no
    template of the catalogue, because the cap made the miner forget its cluster, has the template which that ended with.
    """
    with tidy_shuffles(df.sparkSession):
        return _distinct(df, tokens, order_by, cfg)


def _distinct(df: DataFrame, tokens: str, order_by: Sequence[str], cfg: MinerConfig) -> tuple[DataFrame, DataFrame]:
    t = F.col(quoted(tokens))
    firsts = df.groupBy(_joined(t).alias("_text"), F.size(t).alias("_len")).agg(
        F.min(F.struct(*map(quoted, order_by))).alias("_o"), F.count("*").alias("_w"))
    firsts = _stored(firsts.select(_lists("_text", "_len").alias("tokens"), "_o.*", "_w"), "first-lines")
    lines, catalog = mine_templates(firsts, "tokens", order_by, cfg)
    weights = (lines.join(firsts.select(*map(quoted, order_by), "_w"), list(order_by))
               .groupBy("shard", "local_id").agg(F.sum("_w").alias("size")))
    live = catalog.filter(F.col("tree_ord") > FORGOTTEN).drop("size").join(weights, ["shard", "local_id"], "left")
    gone = weights.join(catalog.select("shard", "local_id"), ["shard", "local_id"], "left_anti").groupBy("shard").agg(
        F.sum("size").alias("size"))
    gone = catalog.filter(F.col("tree_ord") == FORGOTTEN).drop("size").join(gone, "shard", "left")
    catalog = _stored(live.unionByName(gone), "distinct-catalogue")
    found = _stored(map_templates(df, tokens, catalog, "fallback", cfg), "matched-lines")
    # only lines of forgotten clusters are left to their own cluster
    own = (lines.join(ended_templates(lines, catalog, order_by), "cluster_id").select(*map(quoted, order_by), "cluster_id", "template")
           .join(firsts, list(order_by)).select(F.col("tokens").alias(tokens), "template", "cluster_id"))
    lost = found.filter("cluster_id IS NULL").drop("template", "cluster_id").join(own, tokens, "left")
    return found.filter("cluster_id IS NOT NULL").unionByName(lost), catalog


# -- statistics ---------------------------------------------------------------------------------------------------


def cluster_stats(catalog: DataFrame) -> DataFrame:
    """Number of clusters, smallest, largest, mean and total size."""
    return live_templates(catalog).agg(F.count("*").alias("clusters"), F.min("size").alias("min_size"),
                                       F.max("size").alias("max_size"), F.avg("size").alias("avg_size"),
                                       F.sum("size").alias("total_size"))


def cluster_latest_ts(lines: DataFrame, ts: str = "latest_ts") -> DataFrame:
    """Newest time per cluster."""
    return lines.groupBy("cluster_id").agg(F.max(ts).alias("latest_ts"))


def template_listing(catalog: DataFrame, k: int = 5) -> DataFrame:
    """Per (token count, prefix) the number of clusters and the first ``k`` of them in tree order."""
    live = live_templates(catalog)
    counts = live.groupBy("shard", "leaf_path").agg(F.count("*").alias("cluster_count"))
    firsts = (live.withColumn("_r", F.row_number().over(Window.partitionBy("shard", "leaf_path").orderBy("tree_ord")))
              .filter(F.col("_r") <= k))
    return firsts.join(counts, ["shard", "leaf_path"]).select(
        "shard", "leaf_path", "cluster_count", F.col("_r").alias("place"), "cluster_id", "size",
        F.array_join("tokens", " ").alias("template"))


def top_clusters(catalog: DataFrame, k: int = 20) -> DataFrame:
    """O2: the ``k`` largest clusters."""
    return (live_templates(catalog).select("cluster_id", "size", F.array_join("tokens", " ").alias("template"))
            .orderBy(F.desc("size"), "cluster_id").limit(k))


def template_token_stats(catalog: DataFrame) -> DataFrame:
    """Templates, distinct templates, repeats, shortest and longest, distinct tokens."""
    live = live_templates(catalog).withColumn("_text", F.array_join("tokens", " "))
    base = live.agg(F.count("*").alias("templates"), F.count_distinct("_text").alias("distinct_templates"),
                    F.min(F.size("tokens")).alias("min_tokens"), F.max(F.size("tokens")).alias("max_tokens"),
                    F.sum(F.size("tokens")).alias("total_tokens"))
    words = live.select(F.explode("tokens").alias("t")).agg(F.count_distinct("t").alias("distinct_tokens"))
    return base.crossJoin(F.broadcast(words)).withColumn(  # two one-row sides
        "repeated_templates", F.col("templates") - F.col("distinct_templates"))


