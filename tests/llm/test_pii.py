"""Personal data against a plain reading of the patterns."""

import hashlib
import re

from pyspark.sql import functions as F

from faultline.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+".replace(r"[\x20-]", "[ -]"))
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    n = lambda s: re.sub("[^0-9]", "", s)
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in n(m[0])]
        total = sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(n(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


TEXTS = [
    None, "", "no data here", "a@b.c@d.e and a@b.cd_x@y.z, x@@y.zz .@-.-", "@@@", "a@b a@b. a@b..c", "1.2.3.4.5 01.02.03.004 1.2.3.256",
    "256.1.1.1.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111", "4111 1111 1111 1112 0000000000000000", "123456789012345678901234",
    "+1 (555) 010-9999 +49 30 123456 + 1 +12", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "ÄÖ 𝒳 a.b@ä.de a.b@c.de é+1 555 0100 222",
    "1" * 5000, "a" * 5000 + "@", "@" * 3000, "1." * 3000, "+1 " * 2000, "x@" * 2000 + "y.z",
]


def test_base_spans_match_the_plain_patterns(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(i, t, i) for i, t in enumerate(TEXTS + TEXTS[3:6])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found long").unionByName(
        spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id") + 1000, "text", F.lit(0).alias("found"))
        .toDF("doc_id", "text", "found"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = pii.span_digest(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain(texts[r.doc_id] or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in pii.BASE), r.doc_id
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and s.split(":")[0] in pii.BASE] == [s for s in joined.split(",") if s]


def test_added_kinds_and_context():
    kinds = lambda t: [(k, t[a:b]) for k, a, b, _ in pii.find(t)]
    assert ("iban", "DE89 3704 0044 0532 0130 00") in kinds("Konto DE89 3704 0044 0532 0130 00.")
    assert not [k for k, *_ in pii.find("Konto DE88 3704 0044 0532 0130 00.") if k == "iban"]
    assert kinds("my ssn is 536-90-4399") == [("ssn", "536-90-4399")]
    assert kinds("row 536-90-4399") == []
    assert kinds('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"') == [("secret", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff")]
    assert kinds("token = aaaaaaaaaaaaaaaaaaaa") == []
    near, far = pii.find("call +1 555 0100 2222")[0], pii.find("lalala +1 555 0100 2222")[0]
    assert near[3] > far[3]


def test_redaction_keeps_columns_and_rows(spark):
    docs = spark.createDataFrame([(1, "mail a@b.de now", 15, "k"), (2, None, None, "k"), (2, "", 0, "k")],
                                 "doc_id long, text string, n_chars long, spans string")
    got = {(r.doc_id, r.text, r.n_chars, r.spans) for r in pii.redact_documents(docs).collect()}
    assert got == {(1, "mail <EMAIL> now", 16, "k"), (2, None, None, "k"), (2, "", 0, "k")}
    assert pii.redact_documents(docs.limit(0)).count() == 0
    assert pii.span_digest(docs.limit(0)).count() == 0


def test_ibans_end_where_their_country_says():
    ibans = lambda t: [t[a:b] for a, b in pii.ibans(t)]
    de, gb = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"
    for after in (" BIC COBADEFFXXX", " EUR 500", " 2024 invoice", " A deposit", " ", ".", " B", ""):
        assert ibans(f"IBAN {de}{after}") == [de] and ibans(f"IBAN {gb}{after}") == [gb], after
    assert ibans(f"{gb} {gb} {de} {de}") == [gb, gb, de, de]
    assert ibans(f"AB12 IBAN {gb}") == [gb]
    assert ibans(f"{de[:-1]}1 BIC COBADEFFXXX") == [] and ibans(f"{de}A") == []
    other = next(c for c in (f"ZZ{i:02d}00001111222233" for i in range(98)) if pii.mod97(c))
    assert ibans(f"{other} BIC") == [other]
    line = f"IBAN {de} BIC COBADEFFXXX"
    assert pii.blank(line, pii.find(line)) == "IBAN <IBAN> BIC COBADEFFXXX"
    assert ibans("DE89 " * 20000) == []
