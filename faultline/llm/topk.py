"""Exact top-k by inner product, term at a time.

Query rows and candidate rows are dealt into blocks of bounded size, and every block of queries meets every block of
candidates in one group. There, the candidates become posting lists per component; each component of the sparse query
rows scatters its weighted postings into a dense array of scores, and a partition selection keeps k per query. The
winners of all blocks are merged per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from faultline.session import fresh_dir

QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 4096
#: Cells of a score array at a time.
CELLS = 1 << 21
#: Smallest and largest 64-bit integer.
INT64 = (-(1 << 63), (1 << 63) - 1)


def quantized(vectors: DataFrame, id_column: str, vector_column: str, scale: int = 256) -> DataFrame:
    """``uid, vec_id, v`` with ``v = floor(scale * x)``; vectors that are null or hold null or non-finite values go.

    A value beyond 64 bits becomes the nearest 64-bit integer.
    """
    good = F.forall("x", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("x"))
    return (rows.withColumn("uid", F.monotonically_increasing_id()).filter(F.col("x").isNotNull() & good)
            .select("uid", "vec_id", F.transform("x", lambda x: F.floor(x * scale)).alias("v")))


class Postings:
    """Per component the rows that have it, and their values; zero values are left out, missing ones count as zero."""

    def __init__(self, lists: pa.Array) -> None:
        lengths = np.diff(lists.offsets.to_numpy())
        self.n = len(lengths)
        row = np.repeat(np.arange(self.n), lengths)
        term = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        value = lists.flatten().to_numpy(zero_copy_only=False)
        keep = value != 0
        row, term, value = row[keep], term[keep], value[keep]
        order = np.argsort(term, kind="stable")
        row, term, value = row[order], term[order], value[order]
        self.terms, starts = np.unique(term, return_index=True)
        self.parts = {int(t): (r, v) for t, r, v in zip(self.terms, np.split(row, starts[1:]), np.split(value, starts[1:]))}
        self.largest = max(abs(int(value.min())), abs(int(value.max()))) if len(value) else 0
        self.longest = int(lengths.max()) if self.n else 0


def scores(queries: Postings, candidates: Postings, first: int, last: int) -> np.ndarray:
    """Integer inner products of the query rows ``first`` to ``last`` with all candidates.

    They are added up exactly at any magnitude; a sum beyond 64 bits becomes the nearest 64-bit integer.
    """
    small = queries.largest * candidates.largest * max(1, min(queries.longest, candidates.longest)) < 1 << 62
    out = np.zeros((last - first, candidates.n), np.int64 if small else object)
    for term, (query_rows, weights) in queries.parts.items():
        if term not in candidates.parts:
            continue
        rows, values = candidates.parts[term]
        here = slice(*np.searchsorted(query_rows, (first, last)))
        at, weight = query_rows[here] - first, weights[here]
        if not small:
            weight, values = weight.astype(object), values.astype(object)
        if len(rows) == candidates.n:
            out[at] += weight[:, None] * values
        else:
            out[np.ix_(at, rows)] += weight[:, None] * values
    return out if small else np.clip(out, *INT64).astype(np.int64)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding",
          scale: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows of every row for which ``is_query`` holds.

    ``is_query`` is an expression over ``vec_id``. Ties go to the smaller id. Rows that repeat an id are rows of their
    own: each is a candidate for the others, and each query row has its own ranks. Vectors of unequal lengths are compared
    over the components both have; an empty one scores 0. Components and scores beyond 64 bits count as the nearest 64-bit
    integer, so such scores tie. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    path = fresh_dir(spark, "vectors")
    quantized(vectors, id_column, vector_column, scale).write.parquet(path)
    rows = spark.read.parquet(path)
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).first()
    blocks = [max(1, -(-n // most)) for n, most in ((sizes["q"], QUERY_BLOCK), (sizes["n"], CANDIDATE_BLOCK))]

    def dealt(df: DataFrame, own: str, mine: int, other: str, others: int) -> DataFrame:
        turn = F.pmod(F.monotonically_increasing_id(), F.lit(mine))
        return (df.withColumn(own, turn.cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))))

    queries = dealt(rows.filter(is_query), "q", blocks[0], "c", blocks[1])
    candidates = dealt(rows, "c", blocks[1], "q", blocks[0])
    schema = pa.schema([("uid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def score(query_rows: pa.Table, candidate_rows: pa.Table) -> pa.Table:
        if not query_rows.num_rows or not candidate_rows.num_rows:
            return schema.empty_table()
        asked, offered = (Postings(t["v"].combine_chunks()) for t in (query_rows, candidate_rows))
        query_uid, uid = query_rows["uid"].to_numpy(), candidate_rows["uid"].to_numpy()
        ids = candidate_rows["vec_id"].fill_null(np.iinfo(np.int64).max).to_numpy()
        step = max(1, CELLS // offered.n)
        at, winners, won = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for first in range(0, asked.n, step):
            found = scores(asked, offered, first, min(first + step, asked.n))
            for i, row in enumerate(found):
                other = np.flatnonzero(uid != query_uid[first + i])
                own = row[other]
                if len(own) > k:
                    enough = np.partition(own, len(own) - k)[len(own) - k]
                    other, own = other[own >= enough], own[own >= enough]
                best = np.lexsort((ids[other], -own))[:k]
                at += [first + i] * len(best)
                winners.append(other[best])
                won.append(own[best])
        at, winners = np.array(at, np.int64), np.concatenate(winners)
        return pa.Table.from_arrays(
            [query_rows["uid"].take(pa.array(at)), query_rows["vec_id"].take(pa.array(at)),
             candidate_rows["vec_id"].take(pa.array(winners)), pa.array(np.concatenate(won), pa.int64())], schema=schema)

    found = queries.groupBy("q", "c").cogroup(candidates.groupBy("q", "c")).applyInArrow(
        score, "uid long, query_id long, vec_id long, score long")
    order = Window.partitionBy("uid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
