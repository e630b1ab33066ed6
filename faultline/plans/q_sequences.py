"""Queries of sequences, vocabularies, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions.text import tokens_of
from faultline.operators import order, sequences, vocab
from faultline.operators.templates import live_templates, mine_templates
from faultline.plans import stand_ins
from faultline.plans.registry import query, table
from faultline.plans.sequences import PRODUCTION, device_sequences, keyed_events, masked_tokens
from faultline.plans.stand_ins import INCIDENTS, KEY_EVENTS, with_views
from faultline.session import settle

_IDS = "string_agg(CAST(log_key AS VARCHAR), ' ' ORDER BY timestamp, event_id)"


def _ids_text(df, col="ids"):
    return df.withColumn(col, F.array_join(F.col(col).cast("array<string>"), " "))


def _hopping_sql(part: str = "ip") -> str:
    return f"""
SELECT {part}, e.w AS window_end, {_IDS} AS ids, arg_min(device_id, ROW(timestamp, event_id)) AS device_id,
       max(CASE WHEN us > (e.w - 300) * 1000000 THEN label ELSE 0 END) AS label
FROM (SELECT k.*, unnest(generate_series(CAST(ceil(us / 300000000.0) AS BIGINT) * 300,
             CAST(floor((us + 900000000) / 300000000.0) AS BIGINT) * 300, 300)) AS w FROM keyed k) e
JOIN (SELECT {part}, CAST(ceil(min(us) / 300000000.0) AS BIGINT) * 300 + 300 AS lo,
             CAST(ceil(max(us) / 300000000.0) AS BIGINT) * 300 AS hi FROM keyed GROUP BY {part}) b USING ({part})
WHERE e.w BETWEEN lo AND hi GROUP BY {part}, e.w"""


@query("w8_hopping_sequences", with_views(_hopping_sql(), keyed=KEY_EVENTS))
def _(spark, sf):
    return _ids_text(device_sequences(stand_ins.key_events(spark, sf)))


@query("w8_hopping_slices", with_views(
    _hopping_sql("ip, slice").replace("SELECT ip, slice, e.w", "SELECT ip, slice, e.w"),
    keyed=f"SELECT *, strftime(timestamp, '%Y-%m-%d') || '-' || (hour(timestamp) // 4) AS slice FROM ({KEY_EVENTS})"))
def _(spark, sf):
    return _ids_text(device_sequences(stand_ins.key_events(spark, sf), slice_hours=4))


@query("w7_tumbling_sequences", with_views(f"""
SELECT ip, {_IDS} AS ids, CAST(ceil(max(us) / 900000000.0) AS BIGINT) * 900 AS window_end,
       arg_min(device_id, ROW(timestamp, event_id)) AS device_id, max(label) AS label
FROM keyed GROUP BY ip, us // 900000000""", keyed=KEY_EVENTS))
def _(spark, sf):
    return _ids_text(sequences.tumbling_sequences(stand_ins.key_events(spark, sf)))


@query("w9_fixed_size_sequences", with_views(f"""
SELECT ip, rn // 20 AS chunk, {_IDS} AS ids, max(label) AS label
FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY timestamp, event_id) - 1 AS rn FROM keyed) GROUP BY ALL""",
                                          keyed=KEY_EVENTS))
def _(spark, sf):
    return _ids_text(sequences.fixed_size_sequences(stand_ins.key_events(spark, sf), 20))


# ---- vocabulary


def _turns(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "role",
                    tokens_of(F.col("text")).alias("tokens"))


_TURNS = r"""
SELECT conv_id * 1000 + turn AS id, conv_id, role,
  list_filter(regexp_split_to_array(text, '[\s\p{Z}\x0b\x1c-\x1f\x{85}]+'), lambda t: t <> '') AS tokens FROM conversations"""
_SPECIALS = "(VALUES ('<pad>', 0), ('<unk>', 1), ('<eos>', 2), ('<sos>', 3), ('<mask>', 4)) AS s(token, id)"


def _vocab_sql(counts: str, order_by: str = "freq DESC, token", n: str = "") -> str:
    return f"""
SELECT token, id, 0 AS freq FROM {_SPECIALS} UNION ALL
SELECT token, row_number() OVER (ORDER BY {order_by}) + 4 AS id, freq FROM ({counts}) {n}"""


_WORDS = "SELECT token, count(*) AS freq FROM (SELECT unnest(tokens) AS token FROM turns) GROUP BY token"


@query("v1_build_vocab", with_views(_vocab_sql(_WORDS + " HAVING count(*) >= 2"), turns=_TURNS))
def _(spark, sf):
    return vocab.build_vocab(_turns(spark, sf), "tokens", min_freq=2)


@query("v1_build_vocab_capped", with_views(_vocab_sql(_WORDS + " ORDER BY freq DESC, token LIMIT 500"), turns=_TURNS))
def _(spark, sf):
    return vocab.build_vocab(_turns(spark, sf), "tokens", max_size=500)


@query("v2_build_token_vocab", with_views(_vocab_sql(
    "SELECT DISTINCT token, 1 AS freq FROM (SELECT unnest(tokens) AS token FROM turns)", "token"), turns=_TURNS))
def _(spark, sf):
    return vocab.build_token_vocab(_turns(spark, sf))


@query("v3_build_device_vocab", """
SELECT token, id, 0 AS freq FROM (VALUES ('<pad>', 0), ('<unk>', 1)) AS s(token, id) UNION ALL
SELECT token, row_number() OVER (ORDER BY token) + 1, freq
FROM (SELECT CAST(user_id AS VARCHAR) AS token, count(*) AS freq FROM events GROUP BY 1)""")
def _(spark, sf):
    return vocab.build_device_vocab(table(spark, sf, "events"), "user_id")


def _role_vocab(test: str) -> str:
    return _vocab_sql("SELECT token, count(*) AS freq FROM (SELECT unnest(tokens) AS token FROM turns "
                      f"WHERE role {test} 'user') GROUP BY token")


@query("v4_extend_vocab", with_views("""
SELECT token, id, freq FROM a UNION ALL
SELECT token, (SELECT max(id) FROM a) + row_number() OVER (ORDER BY id), freq FROM b WHERE token NOT IN (SELECT token FROM a)
""", turns=_TURNS, a=_role_vocab("="), b=_role_vocab("<>")))
def _(spark, sf):
    t = _turns(spark, sf)
    first = vocab.build_vocab(t.filter("role = 'user'"), "tokens")
    return vocab.extend_vocab(first, vocab.build_vocab(t.filter("role <> 'user'"), "tokens"))


_VOCAB = _vocab_sql(_WORDS + " HAVING count(*) >= 3")
_ENCODED = """
SELECT id, [3] || list_transform(tokens, lambda t: coalesce(m[t], 1)) || [2] AS seq
FROM turns, (SELECT MAP(list(token), list(id)) AS m FROM vocab)"""


@query("v5_encode", with_views("""
SELECT id, array_to_string(seq[1:64] || list_transform(generate_series(1, greatest(64 - len(seq), 0)), lambda x: 0), ' ') AS ids,
       len(seq) AS ids_len FROM enc""", turns=_TURNS, vocab=_VOCAB, enc=_ENCODED))
def _(spark, sf):
    t = _turns(spark, sf)
    words = vocab.build_vocab(t, "tokens", min_freq=3)
    return _ids_text(vocab.encode(t, "tokens", "id", words, 64, sos=True, eos=True)).select("id", "ids", "ids_len")


@query("v6_decode", with_views("""
SELECT id, array_to_string(['<sos>'] || list_transform(tokens, lambda t: CASE WHEN m[t] IS NULL THEN '<unk>'
  WHEN m[t] >= 1000 THEN '<' || m[t] || '>' ELSE t END) || ['<eos>'], ' ') AS text
FROM turns, (SELECT MAP(list(token), list(id)) AS m FROM vocab)""", turns=_TURNS, vocab=_VOCAB))
def _(spark, sf):
    t = _turns(spark, sf)
    words = vocab.build_vocab(t, "tokens", min_freq=3)
    rows = vocab.encode(t, "tokens", "id", words, sos=True, eos=True)
    return vocab.decode(rows, "ids", "id", words.filter("id < 1000")).select("id", "text")


@query("v7_next_token_pairs", with_views("""
SELECT ip, window_end, bert_input, bert_label, device_input FROM (
  SELECT ip, window_end,
    array_to_string(cut || list_transform(generate_series(1, 8 - len(cut)), lambda x: 0), ' ') AS bert_input,
    array_to_string(cut[2:] || [2] || list_transform(generate_series(1, 8 - len(cut)), lambda x: 0), ' ') AS bert_label,
    array_to_string([device_id, device_id] || [0, 0, 0, 0, 0, 0], ' ') AS device_input
  FROM (SELECT *, ([3] || list_transform(string_split(ids, ' '), lambda x: CAST(x AS INT)))[1:8] AS cut FROM seqs))""",
                                         keyed=KEY_EVENTS, seqs=_hopping_sql()))
def _(spark, sf):
    seqs = device_sequences(stand_ins.key_events(spark, sf))
    out = vocab.next_token_pairs(seqs, "ids", "device_id", 8)
    for c in ("bert_input", "bert_label", "device_input"):
        out = _ids_text(out, c)
    return out.select("ip", "window_end", "bert_input", "bert_label", "device_input")


@query("v8_mask_tokens")
def _(spark, sf):
    seqs = device_sequences(stand_ins.key_events(spark, sf))
    seqs = seqs.withColumn("row", F.concat_ws("@", "ip", F.col("window_end").cast("string")))
    return vocab.mask_tokens(seqs, "ids", "row", 10).select("row", "masked", "target")


@query("v8_mask_rules", """
SELECT true AS targets_are_ids, true AS others_shown, true AS share_of_targets, true AS share_hidden, true AS share_swapped,
       true AS all_hidden""")
def _(spark, sf):
    """What masking promises, over all positions; shares are within five standard deviations."""
    e = table(spark, sf, "events").select(
        F.col("event_id").alias("row"), F.transform(F.sequence(F.lit(10), F.lit(10) + F.col("event_id") % 9), lambda x: (
            x + F.col("user_id") % 900).cast("int")).alias("ids"))
    every = vocab.mask_tokens(e, "ids", "row", 1000, predict=True).select(
        "row", F.col("masked").alias("m2"), F.col("target").alias("t2"))
    both = vocab.mask_tokens(e, "ids", "row", 1000).join(every, "row")
    at = both.select(F.explode(F.arrays_zip("ids", "masked", "target", "m2", "t2")).alias("_p")).select("_p.*")
    chosen, hidden = F.col("target") != 0, F.col("masked") == vocab.MASK
    swapped = chosen & ~hidden & (F.col("masked") != F.col("ids"))

    def near(part, of, share):
        n = F.count_if(of)
        return F.abs(F.count_if(part) - share * n) <= 5 * F.sqrt(share * (1 - share) * n) + 1

    return at.agg(
        F.bool_and(~chosen | (F.col("target") == F.col("ids"))).alias("targets_are_ids"),
        F.bool_and(chosen | (F.col("masked") == F.col("ids"))).alias("others_shown"),
        near(chosen, F.lit(True), 0.15).alias("share_of_targets"), near(chosen & hidden, chosen, 0.8).alias("share_hidden"),
        near(swapped, chosen, 0.1 * 999 / 1000).alias("share_swapped"),
        F.bool_and((F.col("m2") == vocab.MASK) == (F.col("t2") != 0)).alias("all_hidden"))


@query("v9_pad_batch", """
SELECT event_id AS id, n, rn // 32 AS batch_id,
  CAST(floor(quantile_cont(n, 0.9) OVER (PARTITION BY rn // 32)) AS INT) AS padded_len
FROM (SELECT *, row_number() OVER (ORDER BY n, event_id) - 1 AS rn FROM (SELECT event_id, 2 + event_id % 9 AS n FROM events))""")
def _(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("dev"),
        F.array_repeat(F.lit(5), (F.lit(1) + F.col("event_id") % 9).cast("int")).alias("ids"))
    out = sequences.pad_batch(e, "ids", "id", "dev", 32, percentile=90)
    return out.select("id", (F.size("ids") + 1).alias("n"), "batch_id",
                      F.size("bert_input").alias("padded_len"))


_SEGMENTS = """
SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos,
  count(*) OVER (PARTITION BY l_orderkey) AS n, l_quantity AS a, l_tax AS b FROM lineitem"""


@query("v10_segment_mean", with_views("""
SELECT g.id, g.slot, round(coalesce(avg(p.a), 0), 6) AS a, round(coalesce(avg(p.b), 0), 6) AS b
FROM (SELECT id, unnest(generate_series(0, 3)) AS slot FROM (SELECT DISTINCT id FROM seg)) g
LEFT JOIN (SELECT id, a, b, CASE WHEN n > 4 THEN pos * 4 // n ELSE pos * (4 // n) + r END AS slot
           FROM (SELECT *, unnest(generate_series(0, CASE WHEN n > 4 THEN 0 ELSE 4 // n - 1 END)) AS r FROM seg)) p
ON p.id = g.id AND p.slot = g.slot GROUP BY ALL""", seg=_SEGMENTS))
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    ranked = order.global_rank(li, ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], by=["l_orderkey"], name="pos")
    rows = ranked.select(F.col("l_orderkey").alias("id"), "pos", F.array("l_quantity", "l_tax").alias("vec"))
    out = sequences.segment_mean(rows, "id", "pos", "vec", 4)
    return out.select("id", "slot", F.round(F.col("vec")[0], 6).alias("a"), F.round(F.col("vec")[1], 6).alias("b"))


# ---- order


@query("g0_global_rank", "SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) - 1 AS rank FROM events")
def _(spark, sf):
    return order.global_rank(table(spark, sf, "events"), [F.desc("value"), "event_id"]).select("event_id", "rank")


@query("g0_rank_within_key", """
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS rank FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events")
    return order.global_rank(e, ["value", "event_id"], by=["user_id"]).select("event_id", "rank")


@query("g0_running_sums", """
SELECT event_id, sum(user_id) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events")
    return order.running_sums(e, ["ts", "event_id"], {"total": "user_id"}).select("event_id", "total")


@query("o1_sort_stable", "SELECT ts, user_id, event_id FROM events ORDER BY ts, user_id, event_id")
def _(spark, sf):
    return order.sort_stable(table(spark, sf, "events").select("ts", "user_id", "event_id"), ["ts", "user_id"], "event_id")


@query("o2_top", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 20")
def _(spark, sf):
    return order.top_by(table(spark, sf, "events").select("event_id", "value"), [F.desc("value"), F.asc("event_id")], 20)


@query("o3_length_batches", with_views("""
SELECT batch_id, count(*) AS n, sum(id) AS ids, min(len) AS shortest, max(len) AS longest
FROM (SELECT id, len, (row_number() OVER (ORDER BY len, id) - 1) // 64 AS batch_id
      FROM (SELECT id, len(tokens) AS len FROM turns)) GROUP BY batch_id""", turns=_TURNS))
def _(spark, sf):
    t = _turns(spark, sf).select("id", F.size("tokens").alias("len"))
    out = order.length_bucket_batches(t, "len", "id", 64)
    return out.groupBy("batch_id").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.min("len").alias("shortest"),
                                       F.max("len").alias("longest"))


@query("o3_deal_to_workers", with_views("""
SELECT i % 3 AS worker, count(*) AS batches FROM (SELECT unnest(generate_series(0, CAST(ceil(b / 3.0) AS BIGINT) * 3 - 1)) AS i
  FROM (SELECT CAST(ceil(count(*) / 64.0) AS BIGINT) AS b FROM turns)) GROUP BY 1""", turns=_TURNS))
def _(spark, sf):
    t = _turns(spark, sf).select("id", F.size("tokens").alias("len"))
    out = order.length_bucket_batches(t, "len", "id", 64, world=3).select("batch_id", "slot", "worker").distinct()
    return out.groupBy("worker").agg(F.count("*").alias("batches"))


@query("sequences_from_lines", with_views(f"""
SELECT ip, window_end, len(string_split(ids, ' ')) AS n, label FROM ({_hopping_sql()})""", inc=INCIDENTS, keyed="""
SELECT event_id, e.ip, timestamp, CAST(epoch_us(timestamp) AS BIGINT) AS us, 5 AS log_key, 0 AS device_id,
       CASE WHEN i.time <= timestamp + INTERVAL 20 MINUTE THEN 1 ELSE 0 END AS label
FROM (SELECT event_id, 'dev-' || user_id AS ip, ts AS timestamp, ts + INTERVAL 5 MINUTE AS t5 FROM events) e
ASOF LEFT JOIN inc i ON e.ip = i.ip AND e.t5 <= i.time"""))
def _(spark, sf):
    """The whole sequence job: mine, match, label, look up, cut into sequences."""
    # masking is most of the work: once, for mining and matching
    lines = settle(masked_tokens(stand_ins.lines(spark, sf)).withColumnRenamed("host", "ip")
                   .select("event_id", "ip", "timestamp", "message", "tokens"))
    order_by = ["timestamp", "event_id"]
    catalog = settle(mine_templates(lines, "tokens", order_by, PRODUCTION)[1])
    keys = vocab.build_template_vocab(live_templates(catalog).select(F.array_join("tokens", " ").alias("t")), "t")
    devices = vocab.build_device_vocab(lines, "ip")
    events = keyed_events(lines, stand_ins.incidents(spark, sf), catalog, keys, devices, PRODUCTION, "fallback")
    return device_sequences(events).select("ip", "window_end", F.size("ids").cast("bigint").alias("n"), "label")
