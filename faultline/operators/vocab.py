"""Vocabularies and token sequences (V1-V8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.clock import quoted
from faultline.operators.joins import lookup_vocab
from faultline.operators.order import global_rank

# fixed values: special tokens, their ids are their positions
SPECIALS = ["<pad>", "<unk>", "<eos>", "<sos>", "<mask>"]
PAD, UNK, EOS, SOS, MASK = range(5)


def _with_specials(spark, ranked: DataFrame, specials: Sequence[str]) -> DataFrame:
    head = spark.createDataFrame([(t, i, 0) for i, t in enumerate(specials)], "token string, id bigint, freq bigint")
    return head.unionByName(ranked)


def vocab_from_counts(counts: DataFrame, min_freq: int = 1, max_size: int | None = None) -> DataFrame:
    """V1 from a (token, freq) table: specials first, then frequency descending, token ascending by code point."""
    usable = counts.filter((F.col("freq") >= max(min_freq, 1)) & ~F.col("token").isin(SPECIALS))
    ranked = global_rank(usable.select("token", "freq"), [F.desc("freq"), "token"], name="_r")
    if max_size is not None:
        ranked = ranked.filter(F.col("_r") < max_size)
    ids = ranked.select("token", (F.col("_r") + len(SPECIALS)).alias("id"), "freq")
    return _with_specials(counts.sparkSession, ids, SPECIALS)


def build_vocab(df: DataFrame, col: str, min_freq: int = 1, max_size: int | None = None) -> DataFrame:
    """V1: vocabulary of an array-of-tokens column. Columns token, id, freq."""
    words = df.select(F.explode(quoted(col)).alias("token")).filter(F.col("token").isNotNull())
    return vocab_from_counts(words.groupBy("token").agg(F.count("*").alias("freq")), min_freq, max_size)


def build_template_vocab(df: DataFrame, col: str) -> DataFrame:
    """V1 keyed on whole templates: the log keys of the sequence model."""
    counts = df.filter(F.col(quoted(col)).isNotNull()).groupBy(F.col(quoted(col)).alias("token")).agg(
        F.count("*").alias("freq"))
    return vocab_from_counts(counts)


def build_token_vocab(templates: DataFrame, col: str = "tokens") -> DataFrame:
    """V2: the distinct tokens of all templates, each counted once, hence in alphabetical order."""
    words = templates.select(F.explode(quoted(col)).alias("token")).distinct().withColumn("freq", F.lit(1).cast("bigint"))
    return vocab_from_counts(words)


def build_device_vocab(df: DataFrame, col: str, max_size: int | None = None) -> DataFrame:
    """V3: pad, unk, then the devices in sorted order; only the ``max_size`` most frequent if capped."""
    counts = (df.select(F.col(quoted(col)).cast("string").alias("token")).filter(F.col("token").isNotNull())
              .groupBy("token").agg(F.count("*").alias("freq")))
    if max_size is not None:
        counts = global_rank(counts, [F.desc("freq"), "token"], name="_f").filter(F.col("_f") < max_size).drop("_f")
    ranked = global_rank(counts, ["token"], name="_r")
    ids = ranked.select("token", (F.col("_r") + 2).alias("id"), "freq")
    return _with_specials(df.sparkSession, ids, SPECIALS[:2])


def extend_vocab(vocab: DataFrame, other: DataFrame, sort: bool = False) -> DataFrame:
    """V4: append the tokens that are new, in their own order or sorted."""
    new = other.join(vocab.select("token"), "token", "left_anti")
    ranked = global_rank(new.select("token", "id", "freq"), ["token"] if sort else ["id"], name="_r")
    top = vocab.agg(F.max("id").alias("_top"))
    added = ranked.crossJoin(F.broadcast(top)).select(  # one-row side
        "token", (F.col("_r") + F.col("_top") + 1).alias("id"), "freq")
    return vocab.select("token", "id", "freq").unionByName(added)


def _ids_per_row(df: DataFrame, col: str, row_id: str, vocab: DataFrame) -> DataFrame:
    """(row_id, _ids): each token looked up; a join, so the vocabulary may be of any size."""
    flat = df.select(quoted(row_id), F.posexplode(quoted(col)).alias("_pos", "_tok"))
    found = lookup_vocab(flat, vocab, "_tok", out="_id", unk=UNK)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_id"))), lambda r: r["_id"].cast("int"))
    return found.groupBy(quoted(row_id)).agg(in_order.alias("_ids"))


def pad_to(ids: Column, length: int | Column, pad: int = PAD) -> Column:
    """Cut to ``length`` or fill up with ``pad``."""
    size = F.lit(length) if isinstance(length, int) else length
    fill = F.array_repeat(F.lit(pad), F.greatest(size - F.size(ids), F.lit(0)).cast("int"))
    return F.concat(F.slice(ids, F.lit(1), size.cast("int")), fill)


def encode(df: DataFrame, col: str, row_id: str, vocab: DataFrame, seq_len: int | None = None, sos: bool = False,
           eos: bool = False, out: str = "ids") -> DataFrame:
    """V5: tokens -> ids, EOS at the end and SOS in front when asked, padded or cut; ``<out>_len`` before that."""
    ids = F.coalesce(F.col("_ids"), F.array().cast("array<int>"))
    if eos:
        ids = F.concat(ids, F.array(F.lit(EOS)))
    if sos:
        ids = F.concat(F.array(F.lit(SOS)), ids)
    rows = df.join(_ids_per_row(df, col, row_id, vocab), row_id, "left").withColumn("_all", ids)
    cut = F.col("_all") if seq_len is None else pad_to(F.col("_all"), seq_len)
    return rows.withColumns({out: cut, f"{out}_len": F.size("_all")}).drop("_ids", "_all")


def decode(df: DataFrame, col: str, row_id: str, vocab: DataFrame, drop_pad: bool = False, out: str = "text") -> DataFrame:
    """V6: ids -> tokens joined by spaces; an id outside the vocabulary reads ``<id>``."""
    flat = df.select(quoted(row_id), F.posexplode(quoted(col)).alias("_pos", "_i"))
    if drop_pad:
        flat = flat.filter(F.col("_i") != PAD)
    side = vocab.select(F.col("id").alias("_id"), F.col("token").alias("_token"))
    named = flat.join(side, F.col("_i") == F.col("_id"), "left").withColumn(
        "_word", F.coalesce("_token", F.concat(F.lit("<"), F.col("_i").cast("string"), F.lit(">"))))
    words = F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_word"))), lambda r: r["_word"])
    lines = named.groupBy(quoted(row_id)).agg(F.concat_ws(" ", words).alias(out))
    return df.join(lines, row_id, "left").withColumn(out, F.coalesce(out, F.lit("")))


def next_token_columns(ids: Column, device: Column, length: int | Column) -> dict[str, Column]:
    """V7 as expressions: model input, next-token target, device track, all of ``length``.

    The target is the input moved by one with EOS appended, also when the input was cut.
    """
    size = F.lit(length) if isinstance(length, int) else length
    cut = F.slice(F.concat(F.array(F.lit(SOS)), ids), F.lit(1), size.cast("int"))
    tail = F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0)))
    target = F.when(F.size(cut) > 1, F.concat(tail, F.array(F.lit(EOS)))).otherwise(F.array(F.lit(PAD)))
    # the device sits at position 0 and, if there is a first token, at position 1
    track = F.when(F.size(ids) > 0, F.array(device, device)).otherwise(F.array(device))
    return {"bert_input": pad_to(cut, size), "bert_label": pad_to(target, size),
            "device_input": pad_to(track, size)}


def next_token_pairs(df: DataFrame, ids: str, device: str, length: int) -> DataFrame:
    """V7 on columns."""
    return df.withColumns(next_token_columns(F.col(quoted(ids)), F.col(quoted(device)).cast("int"), length))


def uniform(seed: int, *parts: Column) -> Column:
    """Repeatable number in [0, 1) from a hash of ``parts``: the same on a retried task."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def mask_tokens(df: DataFrame, col: str, row_id: str, vocab_size: int, ratio: float = 0.15, seed: int = 42,
                predict: bool = False) -> DataFrame:
    """V8: ``ratio`` of the ids become targets: 80 % masked, 10 % replaced at random, 10 % kept; 0 marks the others.

    ``predict`` masks every target.
    """
    key = F.col(quoted(row_id))

    def draw(i: Column) -> Column:
        return uniform(seed, key, i)

    def shown(x: Column, i: Column) -> Column:
        share = draw(i) / ratio
        other = F.floor(uniform(seed + 1, key, i) * vocab_size).cast("int")
        hidden = F.lit(MASK) if predict else F.when(share < 0.8, F.lit(MASK)).when(share < 0.9, other).otherwise(x)
        return F.when(draw(i) < ratio, hidden).otherwise(x)

    ids = F.col(quoted(col))
    return df.withColumns({"masked": F.transform(ids, shown),
                           "target": F.transform(ids, lambda x, i: F.when(draw(i) < ratio, x).otherwise(F.lit(0)))})
