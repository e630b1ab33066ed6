"""Line-first cleaning with DataFrame functions only.

Lines that look like navigation, boilerplate or symbol noise are taken out; a document that loses too much of its text,
is too short, or repeats itself is rejected. Everything about a document is computed from its own row: no exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed values of the rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 50
SYMBOLS = "#*$%&|<>"
BOILERPLATE = ("cookie policy|privacy policy|terms of use|terms of service|terms and conditions|all rights reserved|"
               "enable javascript|lorem ipsum|click here|sign in|log in|subscribe to")

_SPLIT = r"[\x20\x09-\x0D]+"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _step(df: DataFrame, **parts: str) -> DataFrame:
    """Add columns that are computed once, however often later expressions name them."""
    return df.selectExpr("*", "inline(array(named_struct(" + ", ".join(f"'{k}', {v}" for k, v in parts.items()) + ")))")


def line_fails(line: str = "x") -> str:
    """SQL condition: the line goes.

    Symbols: at least three, and more than one in ten words. Navigation: three bars. Shouting: three doubled exclamation
    marks, more than one in ten words. Punctuation: ten words without any sentence mark. Boilerplate: a stock phrase in a
    line of at most 20 words. A line without words stays.
    """
    words = f"(length({line}) - length(replace({line}, ' ', '')) + 1)"
    symbols = f"(length({line}) - length(translate({line}, {_sql(SYMBOLS)}, '')))"
    marks = f"((length({line}) - length(replace({line}, '!!', ''))) / 2)"
    return (f"({symbols} >= 3 AND {symbols} * 10 > {words}) OR length({line}) - length(replace({line}, '|', '')) >= 3 "
            f"OR ({marks} >= 3 AND {marks} * 10 > {words}) OR ({words} >= 10 AND NOT {line} RLIKE '[.!?:;…]') "
            f"OR ({words} <= 20 AND lower({line}) RLIKE {_sql(BOILERPLATE)})")


def judge_quality(docs: DataFrame, text: str | Column = "text") -> DataFrame:
    """``doc`` (the whole input row) and ``quality``, a struct of the counts, the verdict and the cleaned text.

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, base_failed, kept, clean_text``. A null
    text counts as empty: no words, so it is rejected. Texts of any length work; equal rows get equal verdicts; an empty
    table stays empty. Input columns are only seen through ``doc``, so their names cannot clash.

    Repeated three-word windows are found by sorting (hash bits, position) as plain longs; neighbours that share the hash
    bits are compared word by word, so no collision counts.
    """
    col = F.col(text) if isinstance(text, str) else text
    df = docs.select(F.struct("*").alias("doc"), F.coalesce(col.cast("string"), F.lit("")).alias("t"))
    trimmed = r"btrim(t, ' \t\n\u000B\f\r')"
    df = _step(df, bare=trimmed, lines=r"split(t, '\n')")
    df = _step(df, w=f"if(bare = '', array(), split(bare, {_sql(_SPLIT)}))", gone=f"filter(lines, x -> {line_fails()})",
               worded=f"filter(lines, x -> btrim(x, {_sql(' ')} || '\\t\\u000B\\f\\r') <> '')")
    df = _step(df, n="size(w)", bits="length(bin(size(w)))")
    df = _step(df, s="if(n < 4, array(), sort_array(transform(sequence(0, n - 3), i -> "
                     "shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), bits) | cast(i as bigint))))")
    near = "coalesce(shiftright(x, bits) = shiftright(get(s, {}), bits), false)"
    df = _step(df, c=f"transform(filter(s, (x, i) -> {near.format('i + 1')} OR {near.format('i - 1')}), "
                     "x -> cast(x & (shiftleft(1L, bits) - 1L) as int))")
    df = _step(df, e="array_sort(transform(c, p -> named_struct('k', concat_ws(' ', w[p], w[p + 1], w[p + 2]), 'p', p)))")
    same = "coalesce(x.k = get(e, {}).k, false)"
    df = _step(df, d=f"sort_array(transform(filter(e, (x, i) -> {same.format('i + 1')} OR {same.format('i - 1')}), x -> x.p))")
    df = _step(
        df, n_words="cast(n as bigint)", word_chars="cast(length(concat_ws('', w)) as bigint)",
        n_symbols=f"cast(length(t) - length(translate(t, {_sql(SYMBOLS)}, '')) as bigint)",
        n_dup_lines="cast(size(worded) - size(array_distinct(worded)) as bigint)",
        n_repeat_words="aggregate(transform(d, (p, i) -> least(3, coalesce(get(d, i + 1) - p, 3))), 0L, (a, x) -> a + x)",
        lost_chars=f"cast(length(regexp_replace(concat_ws('', gone), {_sql(_SPLIT)}, '')) as bigint)",
        clean_text=f"if(size(gone) = 0, t, array_join(filter(lines, x -> NOT ({line_fails()})), '\\n'))")
    df = _step(df, base_failed=f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")
    return df.selectExpr(
        "doc", "named_struct('n_words', n_words, 'word_chars', word_chars, 'n_symbols', n_symbols, 'n_dup_lines', n_dup_lines, "
        "'n_repeat_words', n_repeat_words, 'lost_chars', lost_chars, 'base_failed', base_failed, "
        f"'kept', NOT base_failed AND 100 * lost_chars <= {MAX_LOST_PERCENT} * word_chars, 'clean_text', clean_text) AS quality")


def clean_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the lines that pass, in the columns of ``docs``; ``n_chars`` follows the text."""
    judged = judge_quality(docs).filter("quality.kept")
    new = {"text": F.col("quality.clean_text"), "n_chars": F.length("quality.clean_text").cast("long")}
    return judged.select(*[(new[c] if c in new else F.col("doc").getField(c)).alias(c) for c in docs.columns])
