"""Model features and model jobs on Spark ML."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Mapping, Sequence
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.ml import Transformer
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.clock import quoted
from faultline.operators.evaluate import roc_auc
from faultline.operators.order import global_rank
from faultline.session import settle

# fixed values: search ranges as (type, low, high, log scale)
SEARCH_SPACE = {
    "colsample_bytree": ("float", 0.5, 1.0, False),
    "learning_rate": ("float", 0.005, 0.3, True),
    "max_bin": ("int", 63, 511, True),
    "max_depth": ("int", 3, 12, False),
    "min_child_samples": ("int", 10, 200, True),
    "min_split_gain": ("float", 0.0, 1.0, False),
    "n_estimators": ("int", 200, 2000, True),
    "num_leaves": ("int", 15, 255, True),
    "reg_alpha": ("float", 1e-9, 10.0, True),
    "reg_lambda": ("float", 1e-9, 10.0, True),
    "subsample": ("float", 0.6, 1.0, False),
    "subsample_freq": ("int", 1, 7, False),
}
# the names that Spark's boosted trees have a counterpart for; columns are sampled per node there, not per tree
GBT_PARAMS = {"colsample_bytree": "featureSubsetStrategy", "learning_rate": "stepSize", "max_bin": "maxBins",
              "max_depth": "maxDepth", "min_child_samples": "minInstancesPerNode", "min_split_gain": "minInfoGain",
              "n_estimators": "maxIter", "subsample": "subsamplingRate"}
#: Ranges of trees grown leaf by leaf with regularised weights; a search has to be told to go without them.
NO_COUNTERPART = ("num_leaves", "reg_alpha", "reg_lambda", "subsample_freq")


# -- text ---------------------------------------------------------------------------------------------------------


def ngrams(c: Column, low: int = 1, high: int = 2) -> Column:
    """Lower-cased words between spaces, and runs of up to ``high`` of them."""
    words = F.filter(F.split(F.lower(c), " "), lambda w: w != "")

    def runs(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(
            F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.concat(*[words if n == 1 else runs(n) for n in range(low, high + 1)])


def term_counts(df: DataFrame, row_id: str, text: str, span: tuple[int, int] = (1, 2)) -> DataFrame:
    """(row_id, term, tf)."""
    grams = ngrams(F.coalesce(F.col(quoted(text)), F.lit("")), *span)
    return df.select(quoted(row_id), F.explode(grams).alias("term")).groupBy(quoted(row_id), "term").agg(
        F.count("*").alias("tf"))


def fit_tfidf(df: DataFrame, row_id: str, text: str, span: tuple[int, int] = (1, 2),
              max_features: int = 1 << 20) -> DataFrame:
    """F1 vocabulary: the most frequent terms of the corpus with ids in term order and smoothed idf."""
    tf = term_counts(df, row_id, text, span)
    terms = tf.groupBy("term").agg(F.sum("tf").alias("corpus_count"), F.count("*").alias("df"))
    top = global_rank(terms, [F.desc("corpus_count"), "term"], name="_r").filter(F.col("_r") < max_features)
    docs = df.agg(F.count("*").alias("_n"))
    idf = F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1
    numbered = global_rank(top.drop("_r"), ["term"], name="term_id")
    return numbered.crossJoin(F.broadcast(docs)).select("term", "term_id", "df", idf.alias("idf"))  # one-row side


def tfidf(df: DataFrame, row_id: str, text: str, vocab: DataFrame | None = None, span: tuple[int, int] = (1, 2),
          max_features: int = 1 << 20) -> DataFrame:
    """F1 as rows (row_id, term, term_id, weight), weights of a row scaled to length 1."""
    vocab = fit_tfidf(df, row_id, text, span, max_features) if vocab is None else vocab
    raw = (term_counts(df, row_id, text, span).join(vocab, "term")
           .withColumn("_w", F.col("tf") * F.col("idf")))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(quoted(row_id))))
    return raw.select(quoted(row_id), "term", "term_id", (F.col("_w") / norm).alias("weight"))


def sparse_text(df: DataFrame, row_id: str, text: str, vocab: DataFrame, size: int, span: tuple[int, int] = (1, 2),
                out: str = "text_vec") -> DataFrame:
    """F1 as one sparse vector per row, made in the JVM without moving a row.

    The vocabulary, at most ``max_features`` of :func:`fit_tfidf`, comes to the driver once and is part of the model.
    """
    terms = vocab.orderBy("term_id").select("term", "idf").toArrow()
    if terms.num_rows != size:
        raise ValueError(f"the vocabulary has {terms.num_rows} terms, not {size}")
    grams = ngrams(F.coalesce(F.col(quoted(text)), F.lit("")), *span)
    counted = CountVectorizerModel.from_vocabulary(terms["term"].to_pylist(), inputCol="_grams", outputCol="_tf").transform(
        df.withColumn("_grams", grams))
    weighed = ElementwiseProduct(scalingVec=Vectors.dense(terms["idf"].to_numpy()), inputCol="_tf", outputCol="_w").transform(counted)
    return Normalizer(p=2.0, inputCol="_w", outputCol=out).transform(weighed).drop("_grams", "_tf", "_w")


# -- numbers and categories ---------------------------------------------------------------------------------------


def columns_with_nulls(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """F2 fit: which columns had NULLs (or NaNs); one aggregate, one row."""
    if not cols:
        return []
    row = df.agg(*[F.coalesce(F.max(_missing(df, c)), F.lit(False)).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[i]]


def _missing(df: DataFrame, col: str) -> Column:
    c = F.col(quoted(col))
    return c.isNull() | F.isnan(c) if df.schema[col].dataType.typeName() in ("float", "double") else c.isNull()


def impute(df: DataFrame, cols: Sequence[str], fill: float = -1, indicated: Sequence[str] | None = None) -> DataFrame:
    """``fill`` for what is missing, and ``<col>_missing`` for the columns that had gaps at fit time."""
    indicated = columns_with_nulls(df, cols) if indicated is None else indicated
    flags = {f"{c}_missing": _missing(df, c).cast("int") for c in indicated}
    fills = {c: F.when(_missing(df, c), F.lit(fill)).otherwise(F.col(quoted(c))).cast("double") for c in cols}
    return df.withColumns({**flags, **fills})


MAX_CATEGORIES = 10_000  # of all columns together


def fit_categories(df: DataFrame, cols: Sequence[str]) -> dict[str, list[str | None]]:
    """F3 fit: sorted categories per column, NULL last; an error beyond ``MAX_CATEGORIES``, as each becomes a column."""
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(quoted(c)).cast("string").alias("value"))
                                  for c in cols])).alias("_s")
    distinct = df.select(stacked).select("_s.*").distinct()
    seen = distinct.limit(MAX_CATEGORIES + 1).collect()
    if len(seen) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} categories in {list(cols)}")
    seen.sort(key=lambda r: (r["col"], r["value"] is None, (r["value"] or "").encode()))
    return {c: [r["value"] for r in seen if r["col"] == c] for c in cols}


def one_hot(df: DataFrame, cols: Sequence[str], categories: Mapping[str, Sequence[str | None]] | None = None) -> DataFrame:
    """one 0/1 column per category but the first; an unseen value is all zeros."""
    categories = fit_categories(df, cols) if categories is None else categories
    return df.withColumns({f"{c}_{v}": F.col(quoted(c)).cast("string").eqNullSafe(F.lit(v)).cast("int")
                           for c in cols for v in list(categories[c])[1:]})


# -- models -------------------------------------------------------------------------------------------------------


class Prepared:
    """Fitted F1-F3: turns a frame into one ``features`` vector per row."""

    def __init__(self, df: DataFrame, row_id: str, numeric: Sequence[str], categorical: Sequence[str] = (),
                 text: str | None = None, max_features: int = 1 << 20):
        self.row_id, self.numeric, self.categorical, self.text = row_id, list(numeric), list(categorical), text
        self.indicated = columns_with_nulls(df, self.numeric)
        self.categories = fit_categories(df, self.categorical) if self.categorical else {}
        self.vocab = fit_tfidf(df, row_id, text, max_features=max_features) if text else None
        self.text_size = self.vocab.count() if text else 0
        dummies = [f"{c}_{v}" for c in self.categorical for v in self.categories[c][1:]]
        self.plain = [*self.numeric, *[f"{c}_missing" for c in self.indicated], *dummies]

    def names(self, spark) -> DataFrame:
        """(idx, feature): names in vector order, as a table."""
        plain = [(self.text_size + i, c) for i, c in enumerate(self.plain)]
        out = spark.createDataFrame(plain, "idx bigint, feature string")
        return out.unionByName(self.vocab.select(F.col("term_id").alias("idx"), F.col("term").alias("feature"))) \
            if self.text else out

    def transform(self, df: DataFrame) -> DataFrame:
        out = one_hot(impute(df, self.numeric, indicated=self.indicated), self.categorical, self.categories)
        renamed = {c: f"_f{i}" for i, c in enumerate(self.plain)}
        out = out.withColumns({new: F.col(quoted(c)).cast("double") for c, new in renamed.items()})
        inputs = list(renamed.values())
        if self.text and self.text_size:
            out = sparse_text(out, self.row_id, self.text, self.vocab, self.text_size, out="_text")
            inputs = ["_text", *inputs]
        out = VectorAssembler(inputCols=inputs, outputCol="features").transform(out)
        return out.select(*map(quoted, df.columns), "features")


def fit_classifier(prepared: DataFrame, label: str = "label", weight: str | None = None, seed: int = 42,
                   **params: Any) -> Transformer:
    """boosted trees on ``features``. Class weights are left out unless a weight column is named."""
    model = GBTClassifier(featuresCol="features", labelCol=label, seed=seed, **params)
    if weight:
        model = model.setWeightCol(weight)
    return model.fit(prepared)


def score(df: DataFrame, model: Transformer, threshold: float = 0.5) -> DataFrame:
    """probability of class 1 and the 0/1 decision."""
    out = model.transform(df).withColumn("y_proba", vector_to_array("probability")[1])
    return out.withColumn("y_pred", (F.col("y_proba") >= threshold).cast("int")).drop(
        "rawPrediction", "probability", "prediction")


def score_external(df: DataFrame, features: Sequence[str], loader, threshold: float = 0.5) -> DataFrame:
    """F7 for a model from elsewhere: ``loader()`` runs once per task and returns ``f(pandas frame) -> probabilities``."""
    schema = T.StructType([*df.schema, T.StructField("y_proba", T.DoubleType()),
                           T.StructField("y_pred", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = loader()
        for batch in batches:
            proba = pd.Series(predict(batch[list(features)]), index=batch.index, dtype="float64")
            yield batch.assign(y_proba=proba, y_pred=(proba >= threshold).astype("int32"))

    return df.mapInPandas(run, schema)


def _searched(space: Mapping[str, tuple], without: Sequence[str]) -> dict[str, tuple]:
    """The ranges to search, by name; raises for ranges without a counterpart that ``without`` does not name."""
    lost = [name for name in space if name not in GBT_PARAMS and name not in without]
    if lost:
        raise ValueError(f"no counterpart in Spark's boosted trees, name them in without: {lost}")
    return {name: r for name, r in space.items() if name not in without}


def _value(place: float, kind: str, low: float, high: float, log: bool) -> float | int:
    """What lies at ``place`` between 0 and 1 of a range."""
    v = math.exp(math.log(low) + place * (math.log(high) - math.log(low))) if log else low + place * (high - low)
    return min(high, max(low, round(v))) if kind == "int" else min(high, max(low, v))


def _as_gbt(draw: Mapping[str, Any]) -> dict[str, Any]:
    return {GBT_PARAMS[n]: str(float(v)) if GBT_PARAMS[n] == "featureSubsetStrategy" else v for n, v in draw.items()}


def draw_params(trials: int, seed: int = 0, space: Mapping[str, tuple] = SEARCH_SPACE,
                without: Sequence[str] = ()) -> list[dict[str, Any]]:
    """seeded random draws from the search ranges but ``without``, in the names of Spark's boosted trees."""
    rng, space = random.Random(seed), _searched(space, without)
    return [_as_gbt({name: _value(rng.random(), *r) for name, r in space.items()}) for _ in range(trials)]


def guided_places(past: Sequence[tuple[Mapping[str, float], float]], names: Sequence[str], rng: random.Random,
                  warm: int = 5, candidates: int = 24) -> dict[str, float]:
    """Where to try next, per name between 0 and 1: at random for ``warm`` trials, then where trials of the best tenth are dense
    beside the others. ``past``: (places, score) of the trials so far.
    """
    if len(past) < max(warm, 2):
        return {name: rng.random() for name in names}
    ranked = sorted(past, key=lambda x: -x[1])
    cut = -(-len(past) // 10)
    width = max(0.02, 0.5 / len(past) ** 0.75)

    def dense(x: float, centres: list[float]) -> float:
        # the whole range counts as one more trial
        peaks = sum(math.exp(-((x - c) / width) ** 2 / 2) for c in centres) / (width * math.sqrt(2 * math.pi))
        return (1 + peaks) / (1 + len(centres))

    out = {}
    for name in names:
        good, others = ([places[name] for places, _ in part] for part in (ranked[:cut], ranked[cut:]))
        near = [rng.random() if rng.random() < 1 / (1 + cut) else min(1.0, max(0.0, rng.gauss(rng.choice(good), width)))
                for _ in range(candidates)]
        out[name] = max(near, key=lambda x: dense(x, good) / dense(x, others))
    return out


def _by_time(prepared: DataFrame, ts: str, days: int) -> tuple[DataFrame, DataFrame]:
    """Rows up to max(t) - ``days``, and those after it."""
    anchor = prepared.agg(F.max(quoted(ts))).first()[0] - timedelta(days=days)
    cut = F.lit(anchor).cast(prepared.schema[ts].dataType)
    return settle(prepared.filter(F.col(quoted(ts)) <= cut)), settle(prepared.filter(F.col(quoted(ts)) > cut))


def _held_out_auc(early: DataFrame, late: DataFrame, params: Mapping[str, Any], label: str, seed: int) -> float:
    auc = roc_auc(score(late, fit_classifier(early, label, seed=seed, **params)), y=label).first()["roc_auc"]
    return float("-inf") if auc is None else auc


def search_time_holdout(prepared: DataFrame, ts: str, trials: int, space: Mapping[str, tuple] = SEARCH_SPACE,
                        without: Sequence[str] = (), label: str = "label", days: int = 7, seed: int = 42,
                        warm: int = 5) -> tuple[Transformer, list[dict[str, Any]]]:
    """a guided search. Train up to max(t) - ``days``, validate after it, refit the best ROC-AUC on everything.

    Returns the model and a record per trial, best first: ``trial``, the drawn value of every range by name, ``auc``.
    """
    space, rng = _searched(space, without), random.Random(seed)
    early, late = _by_time(prepared, ts, days)
    past: list[tuple[dict[str, float], float]] = []
    records = []
    for trial in range(trials):
        places = guided_places(past, list(space), rng, warm)
        draw = {name: _value(places[name], *r) for name, r in space.items()}
        past.append((places, _held_out_auc(early, late, _as_gbt(draw), label, seed)))
        records.append({"trial": trial, **draw, "auc": past[-1][1]})
    records.sort(key=lambda r: (-r["auc"], r["trial"]))
    return fit_classifier(prepared, label, seed=seed, **_as_gbt({n: records[0][n] for n in space})), records


def tune_time_holdout(prepared: DataFrame, ts: str, grid: Sequence[Mapping[str, Any]], label: str = "label",
                      days: int = 7, seed: int = 42) -> tuple[Transformer, dict[str, Any], float]:
    """train up to max(t) - ``days``, validate after it, keep the best ROC-AUC, refit on everything."""
    early, late = _by_time(prepared, ts, days)
    scored = [(_held_out_auc(early, late, params, label, seed), -i) for i, params in enumerate(grid)]
    best, at = max(scored)
    params = dict(grid[-at])
    return fit_classifier(prepared, label, seed=seed, **params), params, best
