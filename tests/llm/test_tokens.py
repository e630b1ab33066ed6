"""Token files and packing against the plain tokenizer."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import packing, token_orc
from faultline.llm.tokens import WordEncoder, vocabulary

NAME = "word_bpe_49k.json"
ODD = [
    None, "", "  ", "a\x0bb c\x0cd\x1ce\x85f\xa0g", "<|endoftext|>x <|startoftext|>", "it's 'S don't' s I'LL",
    "é ́a ΑΣ ΑΣ. İ İ.", "x" * 1000, "1234 a1b2 ½ ﬁ", "a　b z​q", "ª. º, ʰ! ǅ; 中文。 中文. हिन्दी. é́. a$. $. ».",
    "word. word, WORD! " * 3000, "same", "same",
]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary(NAME))
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def docs(spark):
    sample = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(100_000 - i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    return sample.unionByName(odd).withColumn("part", F.lit("clash")).withColumn("length", F.lit(0)).cache()


def test_encoder_with_a_full_store(docs, plain):
    import pyarrow as pa

    encoder = WordEncoder(NAME, limit=500)
    texts = [r.text for r in docs.collect()]
    for i in range(0, len(texts), 20):
        ids, counts = encoder.encode(pa.array([t and t.encode() for t in texts[i:i + 20]], pa.binary()))
        assert ids.tolist() == [x for t in texts[i:i + 20] for x in plain(t)]
        assert counts.tolist() == [len(plain(t)) for t in texts[i:i + 20]]


def test_orc_round_trip(spark, docs, plain, tmp_path):
    path = str(tmp_path / "ids")
    token_orc.write_token_orc(docs, path, NAME)
    want, start = {}, 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = plain(r.text)
        want[r.doc_id] = (start, len(ids), crc(ids))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_orc.token_digest(spark, path).collect()} == want
    one = token_orc.read_token_orc(spark, path, [7])
    assert [r.ids for r in one.collect()] == [plain(docs.filter("doc_id = 7").first().text)]
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in one._jdf.queryExecution().toString()


def test_orc_nulls_repeats_and_nothing(spark, tmp_path):
    rows = [(None, "b"), (5, "x y"), (5, "x"), (5, "x"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    token_orc.write_token_orc(docs, str(tmp_path / "a"), NAME)
    got = token_orc.token_digest(spark, str(tmp_path / "a")).collect()
    assert len(got) == 5 and sorted(r.start for r in got)[0] == 0
    assert max(r.start for r in got if r.doc_id is None) < min(r.start for r in got if r.doc_id == 5)
    token_orc.write_token_orc(docs.limit(0), str(tmp_path / "b"), NAME)
    assert token_orc.token_digest(spark, str(tmp_path / "b")).count() == 0


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing_places_every_piece(docs, plain, capacity):
    packed = packing.pack(docs, NAME, capacity, with_ids=True).cache()
    rows = packed.collect()
    texts = {r.doc_id: plain(r.text) for r in docs.collect()}
    got, spaces = defaultdict(list), defaultdict(list)
    for r in rows:
        piece = texts[r.doc_id][r.piece * capacity:(r.piece + 1) * capacity]
        assert (r.start, r.length, r.ids_crc32, r.ids) == (r.piece * capacity, len(piece), crc(piece), piece)
        got[r.doc_id].append(r.piece)
        spaces[r.sequence_id].append((r.offset, r.length))
    assert all(sorted(v) == list(range(-(-len(texts[d]) // capacity))) for d, v in got.items()) and len(got) == len(texts)
    for v in spaces.values():
        end = 0
        for offset, length in sorted(v):
            assert offset == end
            end += length
        assert end <= capacity
    total = sum(map(len, texts.values()))
    assert len(spaces) <= 1.05 * -(-total // capacity) + 1
    out = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in out) == total and all(len(r.ids) <= capacity for r in out)
    packed.unpersist()


def test_packing_nothing_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    assert packing.pack(docs.limit(0), NAME).count() == 0
    rows = packing.pack(docs, NAME).collect()
    assert len(rows) == 3 and len({r.sequence_id for r in rows}) == 1


def test_plan_against_best_fit_decreasing():
    rng = np.random.default_rng(5)
    for lengths in (rng.integers(1, 4097, 3000), np.minimum(4096, np.exp(rng.normal(6.6, 1, 5000)).astype(int) + 1),
                    np.array([7, 7, 7, 4096]), np.array([2049] * 50 + [1] * 3)):
        made = packing.plan(dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)))))
        flat = sorted(n for ns, times in made for n in ns * times)
        assert flat == sorted(lengths.tolist()) and all(sum(ns) <= 4096 for ns, _ in made)
        free = []
        for n in sorted(lengths.tolist(), reverse=True):
            fits = [i for i, f in enumerate(free) if f >= n]
            if fits:
                free[min(fits, key=lambda i: free[i])] -= n
            else:
                free.append(4096 - n)
        assert sum(times for _, times in made) <= 1.02 * len(free) + 1
