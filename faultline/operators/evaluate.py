"""Scores against labels: confusion, report, ROC, precision-recall, gain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.clock import quoted
from faultline.operators.order import global_rank, running_sums

def confusion(df: DataFrame, y: str = "y_true", p: str = "y_proba", threshold: float = 0.5,
              pred: Column | None = None) -> DataFrame:
    """G1: TP, FP, TN, FN at ``p >= threshold`` (or from ``pred``); rows with a negative label are left out."""
    rows = df.select(F.col(quoted(y)).alias("y"),
                     (pred if pred is not None else (F.col(quoted(p)) >= threshold).cast("int")).alias("d"))
    yes, hit = F.col("y") == 1, F.col("d") == 1
    return rows.filter(F.col("y") >= 0).agg(F.count_if(yes & hit).alias("tp"), F.count_if(~yes & hit).alias("fp"),
                                            F.count_if(~yes & ~hit).alias("tn"), F.count_if(yes & ~hit).alias("fn"))


def argmax_pred(scores: Sequence[str]) -> Column:
    """Class of the largest score, the first of equals: the decision of the sequence model."""
    cells = F.array(*[F.struct(F.col(quoted(s)).alias("s"), F.lit(-i).alias("i")) for i, s in enumerate(scores)])
    return -F.array_max(cells)["i"]


def classification_report(df: DataFrame, y: str = "y_true", p: str = "y_proba", threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted means; 0 for empty ratios."""
    c = confusion(df, y, p, threshold)
    tp, fp, tn, fn = (F.col(k).cast("double") for k in ("tp", "fp", "tn", "fn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    def line(name: str, good: Column, wrong: Column, missed: Column) -> Column:
        return F.struct(F.lit(name).alias("class"), ratio(good, good + wrong).alias("precision"),
                        ratio(good, good + missed).alias("recall"),
                        ratio(2 * good, 2 * good + wrong + missed).alias("f1"), (good + missed).alias("support"))

    one = c.select(line("0", tn, fn, fp).alias("a"), line("1", tp, fp, fn).alias("b"),
                   (tp + fp + tn + fn).alias("n"), ratio(tp + tn, tp + fp + tn + fn).alias("acc"))

    def mean(name: str, wa: Column, wb: Column) -> Column:
        parts = [ratio(F.col(f"a.{m}") * wa + F.col(f"b.{m}") * wb, wa + wb).alias(m)
                 for m in ("precision", "recall", "f1")]
        return F.struct(F.lit(name).alias("class"), *parts, F.col("n").alias("support"))

    accuracy = F.struct(F.lit("accuracy").alias("class"), F.col("acc").alias("precision"),
                        F.col("acc").alias("recall"), F.col("acc").alias("f1"), F.col("n").alias("support"))
    rows = F.array(F.col("a"), F.col("b"), accuracy, mean("macro avg", F.lit(1.0), F.lit(1.0)),
                   mean("weighted avg", F.col("a.support"), F.col("b.support")))
    return one.select(F.inline(rows)).withColumn("support", F.col("support").cast("bigint"))


def _cumulative(df: DataFrame, y: str, p: str) -> DataFrame:
    """Per distinct score: positives and negatives at it (pos, neg) and from it upwards (tp, fp)."""
    by_score = df.filter(F.col(quoted(y)) >= 0).groupBy(F.col(quoted(p)).alias("threshold")).agg(
        F.count_if(F.col(quoted(y)) == 1).alias("pos"), F.count_if(F.col(quoted(y)) != 1).alias("neg"))
    return running_sums(by_score, [F.desc("threshold")], {"tp": "pos", "fp": "neg"})


def _with_totals(points: DataFrame) -> DataFrame:
    one = points.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return points.crossJoin(F.broadcast(one))  # one-row side


def roc_curve(df: DataFrame, y: str = "y_true", p: str = "y_proba") -> DataFrame:
    """One point per distinct score, plus the origin at threshold +inf."""
    pts = _with_totals(_cumulative(df, y, p)).select(
        "threshold", F.try_divide("fp", "N").alias("fpr"), F.try_divide("tp", "P").alias("tpr"))
    origin = df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return pts.withColumn("threshold", F.col("threshold").cast("double")).unionByName(origin)


def roc_auc(df: DataFrame, y: str = "y_true", p: str = "y_proba") -> DataFrame:
    """Area under the ROC curve; equal scores share a slanted segment. NULL if a class is missing."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return _cumulative(df, y, p).agg(
        F.try_divide(area, F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def pr_curve(df: DataFrame, y: str = "y_true", p: str = "y_proba") -> DataFrame:
    """Precision, recall and F1 per distinct score."""
    pts = _with_totals(_cumulative(df, y, p))
    precision = F.try_divide("tp", F.col("tp") + F.col("fp"))
    recall = F.coalesce(F.try_divide("tp", "P"), F.lit(1.0))
    return pts.select("threshold", precision.alias("precision"), recall.alias("recall"),
                      F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"))


def pr_auc(df: DataFrame, y: str = "y_true", p: str = "y_proba") -> DataFrame:
    """Trapezoid area under precision-recall, starting at precision 1, recall 0."""
    pts = _with_totals(_cumulative(df, y, p))
    here = F.col("tp") / (F.col("tp") + F.col("fp"))
    tp0 = F.col("tp") - F.col("pos")
    before = F.coalesce(F.try_divide(tp0, tp0 + F.col("fp") - F.col("neg")), F.lit(1.0))
    return pts.agg(F.sum(F.try_divide("pos", "P") * (here + before) / 2).alias("pr_auc"))


def max_f1(df: DataFrame, y: str = "y_true", p: str = "y_proba") -> DataFrame:
    """Best F1 and the lowest threshold that reaches it."""
    best = F.max(F.struct("f1", (-F.col("threshold")).alias("m"))).alias("b")
    return pr_curve(df, y, p).agg(best).select(F.col("b.f1").alias("max_f1"), (-F.col("b.m")).alias("threshold"))


def gain_table(df: DataFrame, q: int = 10, y: str = "y_true", p: str = "y_proba",
               tie: Sequence[str] = ()) -> DataFrame:
    """Rows by falling score, cut at the q-quantiles of their 0-based place; counts and cumulative gain per bin.

    Give ``tie`` a unique key, so that equal scores fall into the same bins on every run.
    """
    ranked = global_rank(df.select(F.col(quoted(y)).alias("y"), F.col(quoted(p)).alias("p"),
                                   *[F.col(quoted(t)).alias(f"_t{i}") for i, t in enumerate(tie)]),
                         [F.desc("p"), *[f"_t{i}" for i in range(len(tie))]], name="_r")
    n = ranked.agg(F.count("*").alias("_n"))
    # integer ceiling of r * q / (n - 1), at least 1; a single row has no quantiles
    step = F.col("_n") - 1
    bin_no = F.greatest(F.lit(1), F.expr(f"(_r * {q} + _n - 2) div (_n - 1)"))
    binned = (ranked.crossJoin(F.broadcast(n)).filter(step > 0)  # one-row side
              .groupBy(bin_no.alias("decile")).agg(
                  F.count("y").alias("observations"), F.sum("y").cast("bigint").alias("events"),
                  F.count_if(F.col("y") == 0).alias("non_events"),
                  F.max("p").alias("proba_max"), F.min("p").alias("proba_min")))
    table = running_sums(binned, ["decile"], {"cumulative_events": "events", "cumulative_observations": "observations"})
    total = binned.agg(F.sum("events").alias("_all"))
    return table.crossJoin(F.broadcast(total)).select(  # one-row side
        "decile", "observations", "events", "non_events", "proba_max", "proba_min", "cumulative_events",
        F.bround(F.try_divide("cumulative_events", "_all") * 100, 2).alias("cumulative_gain_pct"),
        "cumulative_observations",
        F.bround(F.try_divide("cumulative_events", "cumulative_observations") * 100, 2).alias("precision_pct"),
        (F.lit(q + 1) - F.col("decile")).alias("decile_low"))


def predictions(df: DataFrame, y: str = "label", p: str = "y_proba", threshold: float = 0.5,
                ip: str = "ip_address", end: str = "window_5min_end") -> DataFrame:
    """One scored row per window, with its date."""
    return df.select(F.col(quoted(ip)).alias("ip_address"), F.col(quoted(end)).alias("window_5min_end"),
                     F.col(quoted(y)).cast("int").alias("y_true"),
                     (F.col(quoted(p)) >= threshold).cast("int").alias("y_pred"),
                     F.col(quoted(p)).alias("y_proba"), F.to_date(quoted(end)).alias("date"))


def feature_importance_top(importances, names: DataFrame, k: int = 30) -> DataFrame:
    """The ``k`` most important features of a fitted tree model. ``names`` is (idx, feature).

    ``importances`` is the model's sparse vector: only features that some tree uses are in it.
    """
    used = [(int(i), float(v)) for i, v in zip(importances.indices, importances.values)]
    table = names.sparkSession.createDataFrame(used, "idx bigint, importance double")
    return (names.join(table, "idx", "left").select("feature", F.coalesce("importance", F.lit(0.0)).alias("importance"))
            .orderBy(F.desc("importance"), "feature").limit(k))
