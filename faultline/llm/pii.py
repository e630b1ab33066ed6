"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score.

``pii_spans`` is one Arrow function over the text column; every pattern runs in time linear in the text. Offsets are code
points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Fixed order of kinds where spans start together; the first four are the base kinds, which no score can drop.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]
#: Spans of the other kinds need this score.
THRESHOLD = 0.5
#: Code points on either side that are searched for context words.
NEAR = 48

#: kind -> (score without context, words that raise it, words that lower it)
SCORES = {
    "email": (0.9, r"e-?mail|contact|write", r"example"),
    "ip": (0.6, r"\bip\b|host|server|address|login", r"version|release|section"),
    "card": (0.8, r"card|credit|visa|payment|expir", r"order|invoice|isbn"),
    "phone": (0.6, r"phone|call|tel|mobile|fax", r"serial|part"),
    "iban": (0.8, r"iban|bank|account|konto|compte|cuenta", r"serial"),
    "ssn": (0.4, r"\bssn\b|social security|tax(?:payer)? id", r"part|serial|order"),
    "secret": (0.6, r"secret|credential|private|login", r"example|dummy"),
}
_CONTEXT = {k: (s, re.compile(up, re.I), re.compile(down, re.I)) for k, (s, up, down) in SCORES.items()}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Characters of an IBAN by country, as registered.
IBAN_LENGTHS = {c: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in countries.split()}
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?i:api[_-]?key|secret|token|passw(?:or)?d)[ \t]{0,4}[=:][ \t]{0,4}[\"']?([A-Za-z0-9+/_=-]{16,})")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local part, @ and dotted domain, found from each @ outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[Span]:
    return (m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def cards(text: str) -> Iterator[Span]:
    return (m.span() for m in _CARD.finditer(text) if 12 <= m.end() - m.start() and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d))


def phones(text: str) -> Iterator[Span]:
    return (m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15)


def _iban_ends(code: str) -> Iterator[int]:
    """Where an IBAN at the start of ``code`` may end: after the length of its country, else after all of it.

    Countries without a registered length may end after every block, long ones first.
    """
    blocks = [m.start() for m in re.finditer(" ", code)] + [len(code)]
    fixed = IBAN_LENGTHS.get(code[:2])
    if fixed:
        yield from (end for end in blocks if end - code.count(" ", 0, end) == fixed)
        yield len(code)
    else:
        yield from (end for end in reversed(blocks) if end - code.count(" ", 0, end) >= 15)


def ibans(text: str) -> Iterator[Span]:
    """Capitals and digits that follow after a blank may belong to the IBAN or to the next word, also to the next IBAN."""
    m = _IBAN.search(text)
    while m:
        end = next((m.start() + end for end in _iban_ends(m[0]) if mod97(m[0][:end])), None)
        if end:
            yield m.start(), end
        m = _IBAN.search(text, end or m.start() + 1)


def ssns(text: str) -> Iterator[Span]:
    return (m.span() for m in _SSN.finditer(text))


def secrets(text: str) -> Iterator[Span]:
    return (m.span(1) for m in _SECRET.finditer(text) if any(c.isdigit() for c in m[1]))


#: kind -> (characters without which there is nothing to find, finder)
FINDERS: dict[str, tuple[str, Callable[[str], Iterator[Span]]]] = {
    "email": ("@", emails), "ip": (".", ips), "card": ("", cards), "phone": ("+", phones), "iban": ("", ibans),
    "ssn": ("-", ssns), "secret": ("=:", secrets)}


def find(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind."""
    out = []
    for kind, (needs, finder) in FINDERS.items():
        if needs and not any(c in text for c in needs):
            continue
        for start, end in finder(text):
            score, up, down = _CONTEXT[kind]
            around = text[max(0, start - NEAR):start] + " " + text[end:end + NEAR]
            score = min(1.0, score + (0.35 if up.search(around) else 0) - (0.3 if down.search(around) else 0))
            if kind in BASE or score >= THRESHOLD:
                out.append((kind, start, end, round(score, 2)))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def blank(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with every span, or run of overlapping spans, replaced by the kind of its first."""
    out, done = [], 0
    for kind, start, end, _ in spans:
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join(out) + text[done:]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def pii_spans(text: Column) -> Column:
    """Array of ``kind, start, end, score``; empty for null and empty texts."""

    @F.arrow_udf("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    def spans(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("kind", "start", "end", "score"), s)) for s in find(t.as_py() or "")] for t in texts],
                        pa.list_(_SPAN))

    return spans(text)


def redacted(text: Column) -> Column:
    """The text with its personal data replaced by ``<KIND>``; null stays null."""

    @F.arrow_udf("string")
    def redact(texts: pa.Array) -> pa.Array:
        return pa.array([None if (s := t.as_py()) is None else blank(s, find(s)) for t in texts], pa.string())

    return redact(text)


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` redacted and ``n_chars``, where there is one, counted again; all other columns as they are.

    Rows with equal texts get equal results; null texts stay null, an empty table stays empty.
    """
    out = docs.withColumn("text", redacted(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def span_digest(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, hash of the base spans, all spans as ``kind:start:end`` joined by commas."""
    found = docs.select("doc_id", pii_spans(F.col("text")).alias("found"))

    def line(x: Column) -> Column:
        return F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, line), ",")

    def of(*kinds: str) -> Column:
        return F.filter("found", lambda x: x["kind"].isin(*kinds))

    base = of(*BASE)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
