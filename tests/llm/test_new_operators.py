"""Fill-in-the-middle, tokenizer alignment and fingerprints against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultline.llm import alignment, fim, simhash, substring_dedup, topk

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = [None, "", " ", " \t\n", "a", " a", "a ", "one two  three\n", "é𝒳 ü\x0b" * 700, "has <P> inside", "ends <M", "x" * 3000,
       "w " * 3000, "\n".join(f"Line {i} of the text, with words." for i in range(200)), "a<S", "<", "日本語 のテキスト　です" * 50]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def filled(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    units = UNIT.findall(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 80:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def odd_rows(repeats=12):
    rows = [(None if i % 17 == 16 else i, t) for i, t in enumerate(ODD * repeats)]
    return rows + [(3, "same row")] * 3 + [(3, "other text of the id"), (None, None), (None, None)]


def test_fill_in_middle(spark):
    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, "kept") for i, t in rows], "doc_id long, text string, form string").repartition(5)
    got = Counter((r.doc.doc_id, r.doc.text, r.doc.form, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)
                  for r in fim.fill_in_middle(docs).collect())
    assert got == Counter((i, t, "kept", *filled(i, t)) for i, t in rows)
    assert {k[4] for k in got} == {"plain", "psm", "spm"}
    digests = Counter(tuple(r) for r in fim.fim_digest(docs).collect())
    assert digests == Counter((i, *filled(i, t)[:4], sha(filled(i, t)[4]), sha(t or "")) for i, t in rows)
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_borders_of_all_units(monkeypatch):
    """Blocks of a few bytes, many to a text, counted in windows of a few blocks."""
    monkeypatch.setattr(fim, "BLOCK", 7)
    monkeypatch.setattr(fim, "SLICE_BYTES", 50)
    texts = [(t or "").encode() for t in ODD]
    offsets = np.concatenate([[0], np.cumsum(list(map(len, texts)))])
    blocks = fim.Blocks(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for i, text in enumerate(texts):
        units = UNIT.findall(text.decode())
        assert blocks.n[i] == len(units)
        ks = np.arange(len(units) + 1)
        at, points = blocks.borders(np.full(len(ks), i), ks)
        want = ["".join(units[:k]) for k in ks] if len(units) < 400 else None
        if want:
            assert at.tolist() == [len(w.encode()) for w in want] and points.tolist() == list(map(len, want))
    for form in (fim.PLAIN, fim.PSM, fim.SPM):
        assert fim.restored(fim.arranged(b"abcdef", form, 2, 4), form) == b"abcdef"


def plain_groups(own, text):
    """(A ids, B ids, links, groups) token by token, whole texts encoded at once."""
    data = b" " + (text or "").encode()
    streams = []
    if text:
        for k, ids in enumerate((own.words.a.encode(" " + text, add_special_tokens=False).ids, own.words.b.encode(text))):
            parts = [own.words.bytes_of[k][i].as_py() for i in ids]
            if b"".join(parts) != data:
                return [], [], [], ""
            streams.append((ids, np.cumsum(list(map(len, parts))).tolist()))
    if not streams:
        return [], [], [], ""
    (a, ea), (b, eb) = streams
    i = j = 0
    links, groups = [], []
    for end in sorted(set(ea) & set(eb)):
        i2, j2 = ea.index(end) + 1, eb.index(end) + 1
        groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
        links.append((a[i2 - 1], b[j2 - 1]))
        i, j = i2, j2
    return a, b, links, ";".join(groups)


ALIGNED = ODD + ["<|endoftext|> and <s> </s> <unk> <0x41>", "a  b   c\n \nd \te", "▁ mark of its own ▁▁", "nbsp\xa0 x   y",
                 "  leads", "trails  ", "é ﬁ Ǆ", "déjà-vu isn't we'll 12345 3.14"]


def test_alignment(spark):
    own = alignment.Aligner()
    rows = [(None if i == 5 else i % 20, t) for i, t in enumerate(ALIGNED * 3)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_a int").repartition(3)
    plain = {t: plain_groups(own, t) for t in ALIGNED}
    counts = Counter(link for _, t in rows for link in plain[t][2])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    want = Counter()
    for i, t in rows:
        a, b, links, groups = plain[t]
        want[i, len(a), len(b), len(links), groups, sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links)] += 1
    assert Counter(tuple(r) for r in alignment.align_tokens(docs, with_text=True).collect()) == want
    digests = Counter(r.groups for r in alignment.align_tokens(docs).collect())
    assert digests == Counter(sha(plain[t][3]) if plain[t][3] else "" for _, t in rows)
    assert alignment.align_tokens(docs.limit(0)).count() == 0
    assert any(not plain[t][0] for t in ALIGNED if t)


def test_long_text_in_parts_and_full_store(monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_BYTES", 300)
    own = alignment.Aligner(limit=40)
    rnd = random.Random(3)
    text = " ".join(rnd.choice(["word", "two  spaces", "naïve", "x\ny", "日本", "it's", "(ok)", str(rnd.random())]) for _ in range(900))
    a, b, links, groups = plain_groups(own, text)
    counts, spelled, pairs = alignment._aligned(own, pa.array([text.encode()], pa.binary()))
    assert [int(x[0]) for x in counts] == [len(a), len(b), len(links)] and spelled == [groups.encode()]
    assert [(int(p) >> 16, int(p) & 0xFFFF) for p in pairs] == links
    _, spelled, pairs = alignment._aligned(own, pa.array([text.encode() + "▁".encode() * 2], pa.binary()))
    assert spelled == [b""] and not len(pairs)


@pytest.mark.parametrize("piece", [1, 2, 3, 256])
def test_merge_path(piece, monkeypatch):
    monkeypatch.setattr(alignment, "PIECE", piece)
    rnd = np.random.default_rng(piece)
    for _ in range(60):
        a, b = (np.unique(np.append(rnd.integers(1, 60, rnd.integers(0, 40)), 60)) for _ in range(2))
        at, bt = alignment.merge_path(a, b, piece)
        order = sorted([(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()])
        for x, y in zip(at.tolist(), bt.tolist()):
            assert x == sum(side == 0 for _, side in order[:x + y])
        mate, overlaps = alignment.walk(a, b, overlaps=True)
        assert [(x, b[m]) for x, m in zip(a.tolist(), mate.tolist()) if m >= 0] == [(x, x) for x in sorted(set(a) & set(b))]
        starts = [np.append(0, e[:-1]) for e in (a, b)]
        want = {(i, j) for i in range(len(a)) for j in range(len(b))
                if max(starts[0][i], starts[1][j]) < min(a[i], b[j])}
        found = [(int(p), int(q)) for ps, qs in overlaps for p, q in zip(ps, qs)]
        assert set(found) == want and len(found) == len(want)


def printed(text):
    words = set(re.split(r"[\x00-/:-@\[-`{-\x7F]+", (text or "").lower()))
    votes, weight = [0] * simhash.BITS, 0
    for w in words:
        n = min(len(w), simhash.MAX_WEIGHT)
        bits = int(hashlib.sha256(w.encode()).hexdigest()[:simhash.BITS // 4], 16)
        weight += n
        for i in range(simhash.BITS):
            votes[i] += n * (bits >> i & 1)
    return f"{sum(1 << i for i in range(simhash.BITS) if 2 * votes[i] > weight):0{simhash.BITS // 4}x}"


def test_edits_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 4)
    monkeypatch.setattr(simhash, "FEW", 50)
    rows = [(i, t) for i, t in odd_rows(2) if (i, t) != (None, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string").repartition(3)
    got = simhash.compare_with_edits(docs).collect()
    distinct = Counter((i, t or "") for i, t in rows)
    ids = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    hashes = {(r.doc_id, r.text): r.h for r in ids.collect()}
    order = sorted(distinct, key=lambda k: (k[0] is not None, k[0] or 0, hashes[k], k[1]), reverse=True)
    want = Counter()
    for k, key in enumerate(order):
        for nxt, n in ((order[(k + 1) % len(order)], 1), (key, distinct[key] - 1)):
            t, h = key[1], len(key[1]) // 2
            edited = t[:len(t) - h] + nxt[1][:h]
            prints = [int(printed(x), 16) for x in (t, edited, nxt[1])]
            near = [round(1 - (prints[0] ^ p).bit_count() / simhash.BITS, 9) for p in prints[1:]]
            want[key[0], len(t), sha(edited), printed(t), printed(edited), *near] += n
    assert Counter((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got) == +want
    assert simhash.compare_with_edits(docs.limit(0)).count() == 0
    one = simhash.compare_with_edits(docs.filter("doc_id = 13")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_many_equal_rows(spark):
    docs = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("all the same words").alias("text"))
    got = simhash.compare_with_edits(docs.unionAll(spark.createDataFrame([(1, "another one")], docs.schema)))
    assert got.count() == 30_001 and got.filter("near_next < 1").count() == 2


def test_within_radius(spark):
    rnd = random.Random(5)
    mask = (1 << simhash.PIECE_BITS) - 1
    base = [rnd.getrandbits(simhash.BITS) for _ in range(30)]
    prints = set(base)
    for p in base:
        for n in (1, 3, 7, 8, 9):
            prints.add(p ^ sum(1 << i for i in rnd.sample(range(simhash.BITS), n)))
    prints = sorted(prints)
    to = lambda p: [p >> k * simhash.PIECE_BITS & mask for k in range(simhash.PIECES)]
    table = spark.createDataFrame([(to(p),) for p in prints] * 2, "fingerprint array<long>")
    asked = spark.createDataFrame([(to(p),) for p in base[:12]], "fingerprint array<long>")
    for radius in (0, 3, simhash.RADIUS):
        found = Counter((tuple(r["query"]), tuple(r.fingerprint), r.distance)
                        for r in simhash.within_radius(asked, table, radius).collect())
        assert found == Counter((tuple(to(q)), tuple(to(p)), (q ^ p).bit_count()) for q in base[:12] for p in prints
                                if (q ^ p).bit_count() <= radius)
    with pytest.raises(ValueError):
        simhash.within_radius(asked, table, simhash.RADIUS + 1)


def test_fingerprints_of_copies(spark):
    text = "\n".join(f"Sentence number {i} tells of something new, word{i} and thing{i % 7}." for i in range(80))
    near = text.replace("word7 ", "changed ")
    docs = spark.createDataFrame([(1, text), (2, text), (3, near), (4, "nothing alike here at all"), (1, text)],
                                 "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.fingerprints(docs).collect()}
    assert got[1].fingerprint == got[2].fingerprint and got[1].copies == 2 and len(got) == 4
    differ = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(got[a].fingerprint, got[b].fingerprint))
    assert differ(1, 3) < 20 < 80 < differ(1, 4)


def test_scores_beyond_64_bits(spark):
    big, least = (1 << 63) - 1, -(1 << 63)
    rows = [(0, [3e7, 3e7]), (1, [3e7, 3e7]), (2, [1.0, 2.0]), (3, [-3e7, -3e7]), (4, [1e300, -1e300]), (5, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r.vec_id, r.score) for r in topk.top_k(vectors, F.col("vec_id") == 0, 5).orderBy("rank").collect()]
    k = 256 * 30_000_000
    assert got == [(1, 1, big), (2, 2, k * 768), (3, 5, 0), (4, 4, k * big + k * least), (5, 3, least)]


def test_many_rows_of_one_passage(spark):
    docs = spark.range(60_000).select(F.lit(None).cast("long").alias("doc_id"),
                                      F.lit(" ".join(f"w{i}" for i in range(60))).alias("text"))
    got = substring_dedup.remove_repeats(docs, with_text=False).groupBy("n_words", "n_removed").count().collect()
    assert [tuple(r) for r in got] == [(60, 60, 60_000)]
