"""Repeated passages and near duplicates against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import ngram_join, substring_dedup
from faultline.llm.common import mix
from faultline.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stripped(texts, window):
    """Per text (words, removed, hash of what is kept), windows compared as tuples."""
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def odd_texts(seed, n=60):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "w1,", "x\xa0y"]
    passages = [" ".join(rng.choice(vocabulary, 25)) for _ in range(3)]
    texts = [None, "", " \t\n", "a b", "a b", "Is it. " * 60, "go " * 50, passages[0], passages[0], passages[0].replace(" ", "\n")]
    for _ in range(n):
        parts = [" ".join(rng.choice(vocabulary, rng.integers(0, 30))) for _ in range(2)]
        texts.append(str(rng.choice(passages)).join(parts) if rng.random() < 0.6 else " ".join(parts))
    return texts


def test_representatives_decide_every_window():
    rng = np.random.default_rng(3)
    for _ in range(60):
        window, rounds, letters = int(rng.integers(2, 12)), int(rng.integers(0, 4)), int(rng.integers(1, 6))
        base = rng.integers(0, letters, 60).tolist()
        docs = []
        for _ in range(6):
            d = rng.integers(0, letters + 3, rng.integers(0, 40)).tolist()
            a = int(rng.integers(0, 50))
            d[len(d) // 2:len(d) // 2] = base[a:a + int(rng.integers(0, 20))]
            docs.append(d)
        names = mix(np.array([x for d in docs for x in d], np.uint64) + np.uint64(5))
        rows = substring_dedup.representatives(names, np.array([len(d) for d in docs]), window, rounds)
        groups, cells = {}, set()
        for a, s, t, p, c in zip(*(rows[k].tolist() for k in ("a", "s", "text", "p", "c"))):
            groups.setdefault(a, []).append((s, t, p, c))
            cells |= {(t, q) for q in range(p, p + c)}
        assert len(cells) == rows["c"].sum() == sum(max(0, len(d) - window + 1) for d in docs)
        seen = Counter(tuple(d[i:i + window]) for d in docs for i in range(len(d) - window + 1))
        for members in groups.values():
            digests = {m[0] for m in members}
            for _, t, p, c in members:
                for q in range(p, p + c):
                    again = seen[tuple(docs[t][q:q + window])] > 1
                    assert not again if len(members) == 1 else again or len(digests) > 1


@pytest.mark.parametrize("window", [4, 35])
def test_passages_against_brute_force(spark, window):
    texts = odd_texts(window)
    ids = [None, 7, 7] + list(range(100, 100 + len(texts) - 3))
    docs = spark.createDataFrame(list(zip(ids, texts, ["x"] * len(texts))), "doc_id long, text string, n_words string")
    got = substring_dedup.remove_repeats(docs.repartition(3), window).collect()
    want = Counter((i, *r) for i, r in zip(ids, stripped(texts, window)))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_passages_repeated_rows_and_nothing(spark):
    row = (1, " ".join(f"w{i}" for i in range(40)))
    docs = spark.createDataFrame([row, row, (2, "short text")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(docs, with_text=False).collect())
    assert got == [(1, 40), (1, 40), (2, 0)]
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_long_texts_are_whole(spark):
    rng = np.random.default_rng(9)
    words = [f"v{i}" for i in rng.integers(0, 10**6, 120_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[-40:]))], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs, with_text=False).collect()}
    assert got == {1: (120_000, 40), 2: (40, 40)}


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    links = set()
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                links.add((j, i))
    for _ in texts:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    return [len(s) for s in sets], root, links, sets


def near_texts(seed):
    rng = np.random.default_rng(seed)
    texts = [None, "", " \n", "one", "One", "one two", "a b c d e", "A b c d E", "a b c d e f"]
    for _ in range(8):
        base = [f"w{i}" for i in rng.integers(0, 300, rng.integers(8, 80))]
        for _ in range(int(rng.integers(1, 9))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(0, len(copy)))] = f"n{rng.integers(0, 10**6)}"
            texts.append(" ".join(copy))
            base = copy if rng.random() < 0.4 else base
    return texts


@pytest.mark.parametrize("blocks", [False, True])
def test_components_against_brute_force(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(ngram_join, "LIST_BLOCK", 3)
        monkeypatch.setattr(ngram_join, "INDEX_BLOCK", 150)
    texts = near_texts(11)
    docs = spark.createDataFrame([(50 + i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, set_id int")
    sizes, root, links, sets = near(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs.repartition(3)).collect()}
    assert got == {50 + i: (sizes[i], 50 + root[i]) for i in range(len(texts))}
    if not blocks:
        pairs, members = ngram_join.similar_pairs(docs)
        of = {r.doc_id - 50: r.set_id for r in members.collect()}
        want = {frozenset((of[i], of[j])) for i, j in links if sets[i] != sets[j]}
        assert {frozenset((r.u, r.v)) for r in pairs.collect()} == want and all(of[i] is None for i in (0, 1, 2))


def test_near_duplicates_nulls_repeats_and_nothing(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (4, "other words in here now"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect())
    assert got == {(None, 2, 4): 1, (4, 2, 4): 2, (4, 1, 4): 1, (9, 0, 9): 1}
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0


def test_large_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:30] + [f"x{i}"] + base[30:])) for i in range(400)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = near([t for _, t in rows[:3]])[1]
    assert {r.component_id for r in got} == set(want) | ({0} if want == [0, 0, 0] else {r.doc_id for r in got})


def test_connected_copies_are_not_dealt_to_all_blocks(spark, monkeypatch):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base, f"x{i}"])) for i in range(300)] + [(300, " ".join(base[:50] + [f"y{i}" for i in range(20)]))]
    monkeypatch.setattr(ngram_join, "LIST_BLOCK", 32)
    dealt, deal = [], ngram_join._dealt

    def counted(rows, *rest):
        dealt.append(rows.count())
        return deal(rows, *rest)

    monkeypatch.setattr(ngram_join, "_dealt", counted)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{i: 0 for i in range(300)}, 300: 300}
    assert dealt[0] >= 300 and sum(dealt) <= 4 * dealt[0]  # all blocks with all blocks: about ten times as many


def test_graph_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7), (200, 205), (205, 203)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(2, 61)}, 101: 100, 203: 200, 205: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_index_finds_all_links():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))) for _ in range(120)]
    sets += [np.union1d(s, rng.integers(0, 60, 2)) for s in sets[:60]]
    index = ngram_join.Index(sets, 80)
    for i, a in enumerate(sets):
        want = {j for j, b in enumerate(sets) if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))}
        assert set(index.ask(i, np.ones(len(sets), bool)).tolist()) == want
