"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Documents are counted into cells (source, language, topic). A document of a cell is kept with probability
``budget`` times its factor; the factors are raked until the expected tokens meet the targets of all three marginals. Cells
stay in Spark: a step is a window sum over the cells of each category, and all rounds are one plan without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.llm.common import SPACE_CLASS
from faultline.session import settle

DIMENSIONS = ("source", "lang", "topic")
ITERATIONS = 8
#: Cells up to this number are raked in one partition and broadcast to the documents.
FEW_CELLS = 1 << 16
#: Share of all tokens that is kept, where no probability is cut at 1.
BUDGET = 0.6
#: A number is the power that a category's natural share is raised to; a mapping names shares, and what is left to 1 goes
#: to the categories it does not name, by their natural shares; named shares that add up to 1 leave them nothing. So the
#: targets here are powers: every category that occurs has a share, nulls included.
TARGETS: dict[str, float | dict[str, float]] = {"source": 0.7, "lang": 0.5, "topic": 0.9}
NONE = "(none)"


def described(docs: DataFrame) -> DataFrame:
    """``doc`` (the whole row), ``source, lang, topic`` and ``n_tokens``, the words of the text.

    The topic is a stand-in for a classifier's label: the kind of document by its length. Nulls count as ``NONE``, a null
    text as empty.
    """
    n = F.coalesce(F.regexp_count(F.col("text"), F.lit(f"[^{SPACE_CLASS[1:-1]}]+")), F.lit(0)).cast("long")
    rows = docs.select(F.struct("*").alias("doc"), *[F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c)
                                                     for c in DIMENSIONS[:2]], n.alias("n_tokens"))
    topic = F.when(F.col("n_tokens") < 200, "note").when(F.col("n_tokens") < 1000, "article").otherwise("long")
    return rows.withColumn("topic", topic)


def targets_of(cells: DataFrame, name: str, target: float | dict[str, float]) -> DataFrame:
    """``name, target``: shares that add up to 1 over the categories that hold tokens."""
    found = cells.groupBy(name).agg(F.sum("tokens").cast("double").alias("t"))
    if isinstance(target, dict):
        wanted = F.create_map(*[F.lit(x) for kv in target.items() for x in kv])[F.col(name)]
        found = found.withColumn("wanted", F.when(F.col("t") > 0, wanted))
        open_tokens, named = (F.sum(F.when(c, v)) for c, v in (
            (F.col("wanted").isNull(), F.col("t")), (F.col("wanted").isNotNull(), F.col("wanted"))))
        whole = found.agg(F.coalesce(open_tokens, F.lit(0.0)).alias("o"), F.coalesce(named, F.lit(0.0)).alias("g"))
        found = found.crossJoin(whole)  # one row
        rest = F.when(F.col("o") > 0, F.greatest(F.lit(0.0), 1 - F.col("g"))).otherwise(0.0)
        share = F.when(F.col("wanted").isNotNull(), F.col("wanted")).when(
            F.col("o") > 0, rest * F.col("t") / F.col("o")).otherwise(0.0) / F.nullif(F.col("g") + rest, F.lit(0.0))
        return found.select(name, F.coalesce(share, F.lit(0.0)).alias("target"))
    found = found.withColumn("p", F.when(F.col("t") > 0, F.pow("t", F.lit(target))).otherwise(0.0))
    whole = found.agg(F.sum("p").alias("all"))
    return found.crossJoin(whole).select(  # one row
        name, F.coalesce(F.col("p") / F.nullif(F.col("all"), F.lit(0.0)), F.lit(0.0)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, float | dict[str, float]], iterations: int = ITERATIONS) -> DataFrame:
    """``source, lang, topic, factor`` of every cell; ``cells`` has ``tokens`` and is settled.

    A marginal step is a window sum over the cells of a category. Few cells, as counted, are taken into one partition, where
    the windows need no exchange.
    """
    few = cells.count() <= FEW_CELLS
    for d in DIMENSIONS:
        cells = cells.join(targets_of(cells, d, targets[d]).withColumnRenamed("target", f"t_{d}"), d)
    cells = settle(cells.withColumn("factor", F.lit(1.0)))
    if few:
        cells = cells.coalesce(1)
    for _ in range(iterations):
        for d in DIMENSIONS:
            now = F.sum(F.col("tokens") * F.col("factor")).over(Window.partitionBy(d))
            cells = cells.withColumn("now", now).withColumn("factor", F.when(
                F.col("now") > 0, F.col("factor") * F.col(f"t_{d}") / F.col("now")).otherwise(0.0)).drop("now")
    return settle(cells.select(*DIMENSIONS, "factor"))


def mix(docs: DataFrame, targets: dict[str, float | dict[str, float]] = TARGETS, budget: float = BUDGET,
        seed: str = "mix", iterations: int = ITERATIONS) -> DataFrame:
    """``doc, source, lang, topic, n_tokens, probability, kept`` of every document.

    The draw is a hash of ``seed`` and ``doc_id``, so it does not depend on partitions and equal ids are kept or left
    together. Input columns are only seen through ``doc``. Documents whose category holds no words have probability 0; an
    empty table stays empty. Where a probability is cut at 1, that cell falls short of its target.
    """
    rows = described(docs)
    cells = settle(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")))
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    rate = rake(cells, targets, iterations).select(
        *DIMENSIONS, F.least(F.lit(1.0), F.col("factor") * (budget * total)).alias("probability"))
    drawn_by = F.coalesce(F.col("doc.doc_id").cast("string"), F.concat(F.lit("null:"), F.coalesce("doc.text", F.lit(""))))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), drawn_by)), 1, 12), 16, 10).cast("double") / float(1 << 48)
    if cells.count() <= FEW_CELLS:
        rate = F.broadcast(rate)  # counted just now: the texts stay where they are
    return rows.join(rate, list(DIMENSIONS)).withColumn("kept", draw < F.col("probability"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that are kept, in the columns of ``docs``."""
    kept = mix(docs, **options).filter("kept")
    return kept.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
