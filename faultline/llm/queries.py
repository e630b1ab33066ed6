"""Registered queries of the training-data operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm import alignment, fim, lm, mixing, ngram_join, packing, pii, quality, simhash, substring_dedup, token_orc, topk, warc
from faultline.session import fresh_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VOCABULARY = "word_bpe_49k.json"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WORDS_SQL = r"""
w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents)"""

_OP1_SQL = f"""
WITH {_WORDS_SQL},
win AS (SELECT doc_id, p, sha256(array_to_string(w[p:p + 34], ' ')) AS k
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM w)),
rep AS (SELECT doc_id, p FROM win QUALIFY count(*) OVER (PARTITION BY k) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM rep),
pos AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM pos ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""


@query("op1_substring_dedup", _OP1_SQL)
def op1(spark, sf):
    return substring_dedup.remove_repeats(table(spark, sf, "documents"), with_text=False)


@query("op2_best_fit_packing")
def op2(spark, sf):
    return packing.pack(table(spark, sf, "documents"), VOCABULARY)


@query("op3_pii")
def op3(spark, sf):
    return pii.span_digest(table(spark, sf, "documents"))


@query("op4_token_orc")
def op4(spark, sf):
    path = fresh_dir(spark, "token-orc")
    token_orc.write_token_orc(table(spark, sf, "documents"), path, VOCABULARY)
    return token_orc.token_digest(spark, path)


_OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             string_split(t, chr(10)) AS lines FROM d),
tri AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS k
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM w)),
dup AS (SELECT doc_id, p FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
cov AS (SELECT doc_id, sum(least(3, coalesce(q - p, 3)))::BIGINT AS n
        FROM (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM dup) GROUP BY doc_id),
worded AS (SELECT doc_id, list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
                  list_filter(lines, lambda x: __FAILS__) AS gone FROM w),
c AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length(list_aggregate(w.w, 'string_agg', ''))::BIGINT AS chars,
             length(regexp_replace(w.t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(worded.l) - len(list_distinct(worded.l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
             coalesce(length(regexp_replace(list_aggregate(worded.gone, 'string_agg', ''), '[\x20\x09-\x0D]+', '', 'g')), 0) AS lost
      FROM w JOIN worded USING (doc_id) LEFT JOIN cov USING (doc_id))
SELECT doc_id, n_words, coalesce(chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost <= 50 * coalesce(chars, 0) AS kept
FROM c"""
_WORDS = "(length(x) - length(replace(x, ' ', '')) + 1)"
_SYMBOLS = "length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g'))"
_MARKS = "((length(x) - length(replace(x, '!!', ''))) / 2)"
_FAILS = (f"(({_SYMBOLS} >= 3 AND {_SYMBOLS} * 10 > {_WORDS}) OR length(x) - length(replace(x, '|', '')) >= 3 "
          f"OR ({_MARKS} >= 3 AND {_MARKS} * 10 > {_WORDS}) OR ({_WORDS} >= 10 AND NOT regexp_matches(x, '[.!?:;…]')) "
          f"OR ({_WORDS} <= 20 AND regexp_matches(lower(x), '{quality.BOILERPLATE}')))")


@query("op7_quality_rules", _OP7_SQL.replace("__FAILS__", _FAILS))
def op7(spark, sf):
    judged = quality.judge_quality(table(spark, sf, "documents").select("doc_id", "text"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc.doc_id", *[f"quality.{c}" for c in counts])


_OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM k"""


@query("op9_warc", _OP9_SQL)
def op9(spark, sf):
    path = fresh_dir(spark, "warc")
    warc.write_warc(table(spark, sf, "pages"), path)
    return warc.read_warc(spark, path, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: NOT coalesce(isfinite(x), false))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score
      FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
FROM s QUALIFY rank <= 5"""


@query("op5_exact_topk", _OP5_SQL)
def op5(spark, sf):
    return topk.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def _op8_sql() -> str:
    """The raking written out step by step; a mapping of shares must name categories that all occur, or add up to 1."""
    steps, last = [], "w0"
    for i in range(mixing.ITERATIONS):
        for d in mixing.DIMENSIONS:
            new = f"w{i + 1}_{d}"
            steps.append(f"{new} AS (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {d}) > 0 THEN "
                         f"w * t_{d} / sum(w) OVER (PARTITION BY {d}) ELSE 0 END AS w) FROM {last})")
            last = new
    goals = []
    for d, target in mixing.TARGETS.items():
        if isinstance(target, dict):
            cases = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in target.items())
            goals.append(f"g_{d} AS (SELECT {d}, CASE WHEN x IS NOT NULL THEN x ELSE greatest(0, 1 - g) * t / o END / "
                         f"(g + CASE WHEN o > 0 THEN greatest(0, 1 - g) ELSE 0 END) AS t_{d} FROM (SELECT *, "
                         f"coalesce(sum(x) OVER (), 0) AS g, sum(t) FILTER (x IS NULL) OVER () AS o FROM (SELECT {d}, sum(tokens) AS t, "
                         f"CASE WHEN sum(tokens) > 0 THEN CASE {d} {cases} END END AS x FROM cells GROUP BY {d})))")
        else:
            goals.append(f"g_{d} AS (SELECT {d}, pow(t, {target}) / sum(pow(t, {target})) OVER () AS t_{d} "
                         f"FROM (SELECT {d}, sum(tokens)::DOUBLE AS t FROM cells GROUP BY {d}))")
    names = ", ".join(mixing.DIMENSIONS)
    goal_joins = " ".join(f"JOIN g_{d} USING ({d})" for d in mixing.DIMENSIONS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
                  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
k AS (SELECT *, CASE WHEN n_tokens < 200 THEN 'note' WHEN n_tokens < 1000 THEN 'article' ELSE 'long' END AS topic FROM d),
cells AS (SELECT {names}, sum(n_tokens)::BIGINT AS tokens FROM k GROUP BY ALL),
{", ".join(goals)},
w0 AS (SELECT {names}, tokens, {", ".join(f"t_{d}" for d in mixing.DIMENSIONS)}, tokens::DOUBLE AS w FROM cells {goal_joins}),
{", ".join(steps)},
r AS (SELECT {names}, least(1.0, w / nullif(tokens, 0) * {mixing.BUDGET} * (SELECT sum(tokens) FROM cells)) AS p FROM {last})
SELECT doc_id, {names}, n_tokens, round(p, 6) AS probability,
       ('0x' || substr(md5('mix:' || doc_id), 1, 12))::BIGINT / 281474976710656.0 < p AS kept
FROM k JOIN r USING ({names})"""


@query("op8_mix_sources", _op8_sql())
def op8(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source", "lang")
    return mixing.mix(docs).select("doc.doc_id", *mixing.DIMENSIONS, "n_tokens", F.round("probability", 6).alias("probability"), "kept")


_OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
r AS (SELECT doc_id AS d, doc_id AS k FROM documents UNION SELECT r.d, l.b FROM r JOIN l ON l.a = r.k)
SELECT documents.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.k) AS component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN r ON r.d = documents.doc_id GROUP BY documents.doc_id"""


@query("op6_ngram_jaccard_join", _OP6_SQL)
def op6(spark, sf):
    return ngram_join.near_duplicates(table(spark, sf, "documents"))


@query("op10_lm_scoring")
def op10(spark, sf):
    return lm.score_documents(table(spark, sf, "documents"))


_OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
             ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3,
             ('0x' || h[25:32])::BIGINT AS h4 FROM d),
k AS (SELECT *, len(w)::BIGINT AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a,
             greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM w),
c AS (SELECT *, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:], '') AS suf
      FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c"""


@query("op11_fill_in_middle", _OP11_SQL)
def op11(spark, sf):
    return fim.fim_digest(table(spark, sf, "documents"))


@query("op12_tokenizer_alignment")
def op12(spark, sf):
    rows = alignment.align_tokens(table(spark, sf, "documents"))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum",
                       F.col("groups").alias("groups_sha256"))


def _op13_sql() -> str:
    """The votes are counted bit by bit over hexadecimal digits of the terms' digests."""
    pieces = ", ".join(f"('0x' || substr(h, {15 * k + 1}, 15))::BIGINT AS p{k}" for k in range(simhash.PIECES))
    bits = [(k, i) for k in range(simhash.PIECES) for i in range(simhash.PIECE_BITS)]
    votes = ", ".join(f"sum(((p{k} >> {i}) & 1) * weight) AS v{k}_{i}" for k, i in bits)
    ones = ", ".join("(" + " + ".join(f"CASE WHEN 2 * v{k}_{i} > w THEN {1 << i}::BIGINT ELSE 0 END"
                                      for i in range(simhash.PIECE_BITS)) + f") AS f{k}" for k in range(simhash.PIECES))
    digits = " || ".join(f"lpad(to_hex({{0}}.f{k}), 15, '0')" for k in range(simhash.PIECES))
    near = " + ".join(f"bit_count(xor({{0}}.f{k}, {{1}}.f{k}))::INT" for k in range(simhash.PIECES))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
o AS (SELECT *, coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), max(doc_id) OVER ()) AS next_id FROM d),
x AS (SELECT o.doc_id, o.next_id, o.n, o.t, left(o.t, o.n - o.n // 2) || left(d.t, o.n // 2) AS e FROM o JOIN d ON d.doc_id = o.next_id),
k AS (SELECT doc_id, 0 AS kind, t FROM x UNION ALL SELECT doc_id, 1, e FROM x),
m AS (SELECT doc_id, kind, unnest(list_distinct(regexp_split_to_array(lower(t), '{simhash._SPLIT}'))) AS term FROM k),
h AS (SELECT doc_id, kind, least(length(term), {simhash.MAX_WEIGHT}) AS weight, sha256(term) AS h FROM m),
v AS (SELECT doc_id, kind, sum(weight) AS w, {votes} FROM (SELECT doc_id, kind, weight, {pieces} FROM h) GROUP BY ALL),
f AS (SELECT doc_id, kind, {ones} FROM v)
SELECT x.doc_id, x.n::BIGINT AS n_chars, sha256(x.e) AS edited_sha256, lower({digits.format("a")}) AS fingerprint,
       lower({digits.format("b")}) AS edited_fingerprint, 1 - ({near.format("a", "b")})::DOUBLE / {simhash.BITS} AS near_edited,
       1 - ({near.format("a", "c")})::DOUBLE / {simhash.BITS} AS near_next
FROM x JOIN f AS a ON a.doc_id = x.doc_id AND a.kind = 0 JOIN f AS b ON b.doc_id = x.doc_id AND b.kind = 1
JOIN f AS c ON c.doc_id = x.next_id AND c.kind = 0"""


@query("op13_simhash", _op13_sql())
def op13(spark, sf):
    return simhash.compare_with_edits(table(spark, sf, "documents"))
