"""Quality rules, mixing, top-k, archives and language-model scores against brute force; the pipeline; the SQL checks."""

import gzip
import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import lm, mixing, queries, quality, topk, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def counts(text):
    t = text or ""
    w = WORD.findall(t)
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    seen = Counter(tri)
    covered = {j for i, x in enumerate(tri) if seen[x] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed)


PROSE = "\n".join(f"The{i} line{i} has{i} some{i} words{i} and{i} goes{i} on{i}, as{i} lines{i} do{i}." for i in range(12))
TEXTS = [None, "", " \t\n", "\n\n", "a a a a", "a b a b a b " * 30, "é𝒳 " * 60, PROSE, PROSE + "\n" + PROSE,
         PROSE.replace(" and", " ## ** $$ and"), PROSE + "\nHome | About | News | Contact", "x y z " * 200 + PROSE,
         "\n".join(f"Home{i} | About{i} | News{i} | Contact{i}" for i in range(30)), PROSE.replace(".", "").replace(",", "")]


def test_quality_counts_and_verdicts(spark):
    rows = [(i if i else None, t, "extra") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    for r in quality.judge_quality(docs).collect():
        q = r.quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == counts(r.doc.text), r.doc
        assert r.doc.n_words == "extra" and not (q.base_failed and q.kept)
    kept = {r.doc_id: r.text for r in quality.clean_documents(docs).collect()}
    assert kept[7] == PROSE and kept[10] == PROSE and 12 not in kept and 13 not in kept and 9 not in kept
    assert quality.clean_documents(docs).columns == docs.columns
    assert quality.judge_quality(docs.limit(0)).count() == 0


def test_clean_documents_stay(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(labels, "doc_id")
    judged = quality.judge_quality(docs).filter("quality.n_words >= 50").groupBy("doc.quality").agg(
        F.avg(F.col("quality.kept").cast("int")).alias("kept")).collect()
    share = {r.quality: r.kept for r in judged}
    assert share[1] > 0.99 and share[0] < 0.1


def raked(rows, targets, budget, rounds):
    cells = Counter()
    for key, n in rows:
        cells[key] += n
    total = sum(cells.values())
    goals = []
    for d, name in enumerate(mixing.DIMENSIONS):
        t = Counter()
        for key, n in cells.items():
            t[key[d]] += n
        if isinstance(targets[name], dict):
            named = {k: targets[name][k] for k in t if k in targets[name] and t[k]}
            rest, open_ = max(0, 1 - sum(named.values())), sum(n for k, n in t.items() if k not in named)
            raw = {k: named.get(k, rest * n / open_ if open_ else 0) for k, n in t.items()}
        else:
            raw = {k: n ** targets[name] if n else 0 for k, n in t.items()}
        goals.append({k: v / (sum(raw.values()) or 1) for k, v in raw.items()})
    weight = {k: float(n) for k, n in cells.items()}
    for _ in range(rounds):
        for d in range(3):
            now = Counter()
            for k, w in weight.items():
                now[k[d]] += w
            weight = {k: w * goals[d][k[d]] / now[k[d]] if now[k[d]] else 0.0 for k, w in weight.items()}
    return {k: min(1.0, w / cells[k] * budget * total) if cells[k] else 0.0 for k, w in weight.items()}, goals, weight


def test_mixing_against_plain_raking(spark):
    rng = np.random.default_rng(2)
    rows = [(None, None, None, None), (1, "", "s0", "en"), (2, "a b", None, "xx")]
    rows += [(i, "w " * int(rng.choice([3, 300, 1200])), f"s{rng.integers(0, 4)}", str(rng.choice(["en", "de", "fr", "es"])))
             for i in range(3, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("topic", F.lit(1))
    got = mixing.mix(docs, iterations=6).collect()
    assert len(got) == len(rows)
    plain = [((r.source, r.lang, r.topic), r.n_tokens) for r in got]
    want, goals, weight = raked(plain, mixing.TARGETS, mixing.BUDGET, 6)
    for r in got:
        assert r.n_tokens == len((r.doc.text or "").split()) and abs(r.probability - want[(r.source, r.lang, r.topic)]) < 1e-9
        text = f"mix:{'null' if r.doc.doc_id is None else r.doc.doc_id}"
        assert r.kept == (int(hashlib.md5(text.encode()).hexdigest()[:12], 16) / (1 << 48) < r.probability)
    for k, goal in goals[2].items():
        assert abs(sum(w for key, w in weight.items() if key[2] == k) - goal) < 1e-6
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_leaves_no_language_without_a_share(spark):
    rows = [(lang, i) for lang, n in (("en", 400), ("de", 100), ("fr", 100), ("es", 100), (None, 350), ("it", 50)) for i in range(n)]
    docs = spark.createDataFrame([(k, f"w{i} " * 5, "s", lang) for k, (lang, i) in enumerate(rows)],
                                 "doc_id long, text string, source string, lang string")
    got = Counter(r.lang for r in mixing.mixed_documents(docs).collect())
    assert set(got) == {"en", "de", "fr", "es", None, "it"} and got[None] > 50 and got["it"] > 10


def test_mixing_draws_null_ids_one_by_one(spark):
    docs = spark.createDataFrame([(None, f"w{i} b c", "s", "en") for i in range(200)],
                                 "doc_id long, text string, source string, lang string")
    kept = mixing.mixed_documents(docs).count()
    assert abs(kept - 200 * mixing.BUDGET) < 40


@pytest.mark.parametrize("small", [False, True])
def test_top_k_against_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
        monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 7)
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.choice([-0.5, 0.0, 0.25, 0.3], 6)], "e") for i in range(60)]
    vectors += [(100, None, ""), (101, [], ""), (102, [1.0, None], ""), (103, [float("nan")], ""), (150, [float("inf")], ""),
                (200, [0.25], "short"), (0, vectors[0][1], "again"), (201, [3e9] * 6, "large")]
    docs = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, score string")
    good = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in vectors
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = Counter()
    for a, (i, v) in enumerate(good):
        if i % 50 == 0:
            found = sorted((-sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(good) if b != a)[:5]
            want.update((i, k + 1, j, -s) for k, (s, j) in enumerate(found))
    got = Counter(map(tuple, topk.top_k(docs, F.col("vec_id") % 50 == 0, 5).collect()))
    assert got == want
    assert topk.top_k(docs.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é" + "x" * 1500
    rows = [(1, "u1", big), (9, "u\r\n 9", big), (5, None, big), (9, "again", big), (2, "u", "small"), (3, "u", "small"),
            (4, "u", None), (None, "u", "x" * 2000), (6, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = str(tmp_path / "w")
    warc.write_warc(pages, path)
    got = Counter()
    for r in warc.read_warc(spark, path).collect():
        got[(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest)] += 1
        assert r.record_type == "revisit" or hashlib.sha1(r.payload).hexdigest() == r.payload_digest
    want = Counter()
    for page, _, html in rows:
        raw = (html or "").encode()
        revisit = html == big and page != 9
        want[(page, "revisit" if revisit else "response", 9 if revisit else None, len(raw), hashlib.sha1(raw).hexdigest())] += 1
    assert got == want and warc.read_gaps(spark, path).count() == 0
    for part in Path(path).glob("part-*"):
        assert gzip.decompress(part.read_bytes()) is not None
    warc.write_warc(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("known", [0, 2, 1000])
def test_revisits_however_many_payloads_repeat(spark, tmp_path, monkeypatch, known):
    monkeypatch.setattr(warc, "REPEATED", known)
    rows = [(i, "u", None if i % 7 == 0 else str(i % 5) * 1200 if i % 2 else str(i % 3) * 20) for i in range(60)]
    rows += [(i, "u", f"{i}" * 600) for i in range(60, 70)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"))
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    last = {html: i for i, _, html in rows if html and len(html) >= 1000}
    assert got == {i: ("revisit", last[html]) if last.get(html, i) != i else ("response", None) for i, _, html in rows}


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage_finds_what_is_left(spark, tmp_path, zipped):
    rng = np.random.default_rng(7)
    records = [warc.record(i, f"u{i}", bytes(rng.integers(32, 127, 400).tolist()), "00" * 20, None) for i in range(30)]
    parts = [gzip.compress(r) if zipped else r for r in records]
    starts = np.cumsum([0] + [len(p) for p in parts]).tolist()
    data = bytearray(b"".join(parts))
    data[starts[4] - 50] ^= 0xFF  # a bit flip inside
    data[starts[10]:starts[10] + 3] = b"???"  # a lost start
    data = bytes(data[:starts[20] + 30]) + bytes(data[starts[22]:])  # a hole
    data = b"junk" + data[:-25]  # a cut end
    found = list(warc.salvage(data))
    ids = [int(re.search(r"page:(\d+)", h["warc-record-id"])[1]) for *_, rs in found for h, _ in rs]
    assert ids == [i for i in range(30) if i not in (3, 10, 20, 21, 29)]
    assert sum(n for _, n, _, _ in found) == len(data)
    assert [reason is None for _, _, reason, _ in found].count(False) == 5
    (tmp_path / "a.warc").write_bytes(data)
    gaps = warc.read_gaps(spark, str(tmp_path)).collect()
    assert sorted((g.offset, g.length) for g in gaps) == [(o, n) for o, n, why, _ in found if why]
    assert warc.read_warc(spark, str(tmp_path)).count() == 25


def _ids(found):
    return [int(re.search(r"page:(\d+)", h["warc-record-id"])[1]) for *_, rs in found for h, _ in rs]


@pytest.mark.parametrize("level", [0, 6])
def test_salvage_inside_members(spark, tmp_path, level):
    rng = np.random.default_rng(8)
    records = [warc.record(i, f"u{i}", bytes(rng.integers(32, 127, 3000).tolist()), "00" * 20, None) for i in range(100)]
    plain = b"".join(records)
    whole = gzip.compress(plain, level)
    assert _ids(warc.salvage(whole)) == list(range(100)) and len(list(warc.salvage(whole))) == 1
    one = bytearray(plain)  # one record is damaged, the member is not
    one[len(b"".join(records[:40])) + 2000] ^= 1
    member = gzip.compress(bytes(one), level)
    found = list(warc.salvage(member + gzip.compress(records[0])))
    assert _ids(found) == [*range(40), *range(41, 100), 0]
    (gap,) = (x for x in found if x[2])
    a, b = len(b"".join(records[:40])), len(b"".join(records[:41]))
    assert gap[:3] == (0, len(member), f"wrong digest: bytes {a} to {b} of a member's contents")
    cut = list(warc.salvage(whole[:len(whole) // 2]))  # the tail is lost
    ids = _ids(cut)
    assert ids == list(range(len(ids))) and 45 <= len(ids) <= 50
    assert "truncated member" in [x[2] for x in cut]
    bad = whole[:-8] + b"12345678"  # every record is confirmed by its digest
    assert _ids(warc.salvage(bad + gzip.compress(records[7]))) == [*range(100), 7]
    flipped = bytearray(whole)
    flipped[len(whole) * 3 // 4] ^= 0xFF
    ids = _ids(warc.salvage(bytes(flipped) + gzip.compress(records[7])))
    assert ids[:70] == list(range(70)) and ids[-1] == 7 and len(set(ids)) >= len(ids) - 1
    (tmp_path / "a.warc.gz").write_bytes(member)
    (tmp_path / "b.warc.gz").write_bytes(whole[:len(whole) // 2])
    assert warc.read_warc(spark, str(tmp_path)).count() == 99 + len(_ids(cut))
    assert {r.path[-9:] for r in warc.read_gaps(spark, str(tmp_path)).collect()} == {"a.warc.gz", "b.warc.gz"}


@pytest.mark.parametrize("frequent", [lm.FREQUENT, 300, 0])
def test_scores_against_a_plain_model(spark, monkeypatch, frequent):
    """The table of frequent words decides where pairs are looked up, not what they score."""
    sample = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()]
    rows = sample + [(None, "the the"), (9001, None), (9002, ""), (9003, "the and of Zzz"), (9003, "the and of Zzz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    monkeypatch.setattr(lm, "SHARD", 60_000)
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    words = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    count, pair, ahead = Counter(), Counter(), Counter()
    for w, h in zip(words, held):
        if not h:
            tokens = [*w, lm.END]
            count.update(tokens)
            pair.update(zip([lm.START, *w], tokens))
            ahead.update([lm.START, *w])
    n, v = sum(count.values()), len(count)
    got = lm.score_documents(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    by_key = {(i, len(w) + 1): (w, h) for (i, _), w, h in zip(rows, words, held)}

    def p0(x):
        return (count[x] + 0.5) / (n + 0.5 * (v + 1))

    for r in got:
        w, h = by_key[(r.doc_id, r.n_tokens)]
        tokens = [*w, lm.END]
        assert (r.held_out, r.train_tokens, r.n_known) == (h, n, sum(count[x] > 0 for x in tokens))
        assert abs(r.base_score - sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens)) < 1e-6
        score = sum(math.log10(lm.PAIRS * pair[(u, x)] / ahead[u] + (1 - lm.PAIRS) * p0(x) if ahead[u] else p0(x))
                    for u, x in zip([lm.START, *w], tokens))
        assert abs(r.score - score) <= 0.025 * len(tokens)
    assert lm.score_documents(docs.limit(0)).count() == 0


def test_held_out_texts_gain_from_the_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm.score_documents(docs).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_pipeline_takes_nothing_and_odd_rows(spark, tmp_path):
    import corpus_pipeline as cp

    rows = [(None, PROSE, None, None, None), (1, None, "s", "en", 0), (2, "", "s", "en", 0), (3, PROSE, "s", "en", len(PROSE)),
            (4, PROSE, "s", "en", 1), (4, PROSE, "s", "en", 1), (5, PROSE[::-1], "t", "de", 1), (6, PROSE + " a@b.de", "t", "de", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, lang, s, n) for i, t, s, lang, n in rows], schema).withColumn("n_words", F.lit("clash"))
    first = cp.quality_rules(spark, docs, "")
    assert Counter(r.doc_id for r in first.collect()) == Counter({None: 1, 3: 1, 4: 2, 5: 1, 6: 1})
    second = cp.near_duplicates(spark, first, "")
    assert {r.doc_id for r in second.collect()} == {3, 5} and second.columns == docs.columns
    assert all("@" not in r.text for r in cp.personal_data(spark, first, "").collect())
    assert set(cp.mix_sources(spark, second, "").columns) == set(docs.columns)
    assert cp.best_fit_packing(spark, first, "").select("sequence_id").distinct().count() == 1
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_rows_that_share_an_id_only_are_decided_one_by_one(spark):
    import corpus_pipeline as cp

    one, two, three = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, one), (1, two), (2, one + " end"), (7, three), (7, two + " end"), (8, one), (8, three + " other end"),
            (9, two), (9, two), (None, ""), (None, ""), (None, None), (3, " "), (3, " "), (4, "x" + one[2:]), (4, one[:-4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, "").collect())
    assert got == {(1, one): 1, (1, two): 1, (7, three): 1, (None, ""): 2, (None, None): 1, (3, " "): 2}
    odd = " ".join(f"d{i}" for i in range(60))
    docs = spark.createDataFrame([(5, odd), (5, odd + " end"), (5, odd), (6, odd)], "doc_id long, text string")
    assert [r.doc_id for r in cp.near_duplicates(spark, docs, "").collect()] == [5]


def test_pipeline_stages_pass_on_what_they_keep(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = cp.quality_rules(spark, docs, SF).cache()
    assert not [r for r in kept.collect() if len(WORD.findall(r.text)) < 25]
    one = cp.near_duplicates(spark, kept, SF).cache()
    assert one.count() == one.select("doc_id").distinct().count() <= kept.count()
    pure = cp.personal_data(spark, one, SF).cache()
    assert pure.count() == one.count()
    mixed = cp.mix_sources(spark, pure, SF).cache()
    packed = cp.best_fit_packing(spark, mixed, SF)
    assert packed.select("doc_id").distinct().count() == mixed.count() == cp.run(spark, SF).select("doc_id").distinct().count()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, name):
    from oracle import compare, connect

    ok, note, _, _ = compare(spark, connect(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert ok, note
