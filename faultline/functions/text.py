"""Log text: syslog parsing, cleaning, masking, tokens (T1-T6). All of it runs as JVM expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.clock import quoted

# fixed values: syslog line shapes as (pattern, group of the message); group 1 is the device time.
# The first shape that matches wins, so their order is part of the result.
SYSLOG_SHAPES = [
    (r"^<\d+>(\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+)\[(\d+)\]:\s+%([A-Z]+)-(\d+)-([A-Z0-9_]+):\s+"
     r"(.+)$", 8),
    (r"^<\d+>(\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+)\[(\d+)\]:\s+%([A-Z]+)-(\d+):\s+(.+)$", 7),
    (r"^<\d+>(\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+):\s+%([A-Z]+)-(\d+)-([A-Za-z0-9_\-]+):\s+(.+)"
     r"$", 7),
    (r"^<\d+>(\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+):\s*%([A-Z]+)-(\d+):\s+(.+)$", 6),
    (r"^<\d+>(\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+:\s+%([A-Z]+)-(\d+):\s+(.+)$", 5),
    (r"^<\d+>(\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+):\s+([A-Z0-9_]+):\s+(.+)$", 5),
    (r"^\|?<\d+>\d+:\s+(\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2}):\s+%([A-Z_]+)-(\d+)-([A-Z0-9_]+):\s+(.+)$", 5),
    (r"^<\d+>(\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(last message repeated \d+ times)$", 3),
    (r"^<\d+>(\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+):\s+(.+)$", 4),
    (r"^<\d+>(\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+)\[(\d+)\]:\s+([A-Za-z0-9_:\-]+):\s+(.+)$", 6),
    (r"^<\d+>(\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+)\s+([A-Za-z0-9_\-]+):\s+(.+)$", 5),
    (r"^<\d+>(\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+)\s+(.+)$", 4),
]

# fixed values: clean-up replacements in order
CLEANUPS = [
    (r"[()\[\],\->=%*\\><!'\"]+", " "),
    (r" - |--", " "),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", ""),
    (r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b", ""),
    (r"\b\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}\b", ""),
    (r"\b\d{2}:\d{2}:\d{2}\b", ""),
    (r"\b(?!100\b)\d{3,}\b", ""),
    (r"[:.\-]+", " "),
    (r"\s+", " "),
    (r"^\[\w+\]\s*", ""),
]

# fixed values: production masking rules (pattern, name) in order
MASK_RULES = [
    (r"\[\d+\]", "<PID>"),
    (r"(?<= command )('[^']+')", "<CMD>"),
    (r"(?i)(?<= )user\s*(?:([a-zA-Z0-9_\-]+)|=([a-zA-Z0-9_\-]+)|'([^']+)')((?=[^a-zA-Z0-9])|$)", "<USER>"),
    (r"([A-Z][a-z]{2} +\d{1,2} +\d{2}):(\d{2}:\d{2})", "<TIME>"),
    (r"(?<= |<)(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![:\w])", "<MAC_ADD>"),
    (r"seqno:\d+", "<SEQ>"),
    (r"((?<=[^A-Za-z0-9])|^)(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})((?=[^A-Za-z0-9])|$)", "<IPV4>"),
    (r"((?!<:)[A-Za-z0-9]{2,15}-){2,}[A-Za-z0-9]+(?=\s)", "<DEVICE>"),
    (r"\b(?:(?:[a-fA-F0-9]{1,4}:){7}[a-fA-F0-9]{1,4}|(?:[a-fA-F0-9]{1,4}:){1,7}:|::(?:[a-fA-F0-9]{1,4}:){0,"
     r"6}[a-fA-F0-9]{1,4}|(?:[a-fA-F0-9]{1,4}:){1,6}:[a-fA-F0-9]{1,4}|(?:[a-fA-F0-9]{1,4}:){1,5}(?::[a-fA-F"
     r"0-9]{1,4}){1,2}|(?:[a-fA-F0-9]{1,4}:){1,4}(?::[a-fA-F0-9]{1,4}){1,3}|(?:[a-fA-F0-9]{1,4}:){1,3}(?::["
     r"a-fA-F0-9]{1,4}){1,4}|(?:[a-fA-F0-9]{1,4}:){1,2}(?::[a-fA-F0-9]{1,4}){1,5}|[a-fA-F0-9]{1,4}:(?::[a-f"
     r"A-F0-9]{1,4}){1,6}|(?:[a-fA-F0-9]{1,4}:){1,7}[a-fA-F0-9]{1,4}\/\d{1,3}|(?:[a-fA-F0-9]{1,4}:){1,6}:[a"
     r"-fA-F0-9]{1,4}\/\d{1,3}|::(?:[a-fA-F0-9]{1,4}:){0,5}[a-fA-F0-9]{1,4}\/\d{1,3})(?=\s|,|\/|$)", "<IPv6>"),
    (r"0x[0-9a-fA-F]{8,16}", "<MEMORY_ADD>"),
    (r"(?<=[\s=:])[0-9]\d*\b", "<NUM>"),
    (r"https?://[^\s,\"]+(?=[\s,\"]|$)", "<URL>"),
]
MASK_DELIMITERS = [" ", "[", "]", "<", ">", "(", ")", "=", ":"]

# the white space that str.split() knows
_BLANKS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
           "\u2028\u2029\u202f\u205f\u3000")


def parse_syslog(df: DataFrame, col: str = "message") -> DataFrame:
    """Device time and message text of the first matching shape; lines that match none are dropped."""
    raw = F.col(quoted(col))

    def shape(rx: str, group: int) -> Column:
        # group 1 is never empty in a match
        time = F.regexp_extract(raw, rx, 1)
        return F.when(time != "", F.struct(time.alias("device_time"), F.regexp_extract(raw, rx, group).alias("_text")))

    found = F.coalesce(*[shape(rx, g) for rx, g in SYSLOG_SHAPES])
    # a generator is planned once: neither the filter nor the field accesses repeat the patterns
    parsed = df.select("*", F.inline(F.array_compact(F.array(found))))
    return parsed.withColumn(col, F.col("_text")).drop("_text")


def clean_text(c: Column) -> Column:
    """Ordered replacements, trim, lower case."""
    return F.lower(F.trim(reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), CLEANUPS, c)))


def clean_message(df: DataFrame, col: str = "message", out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, clean_text(F.col(quoted(col))))


# an edge of a word spelled as an alternation is tried at every place; the look-around says the same at once
_EDGES = [("((?<=[^A-Za-z0-9])|^)", "(?<![A-Za-z0-9])"), ("((?=[^A-Za-z0-9])|$)", "(?![A-Za-z0-9])")]
_BACK_REFERENCE = re.compile(r"\\[1-9]")


def _for_java(pattern: str) -> str:
    """The pattern with Unicode classes, and with cheap word edges unless numbered groups are referred to."""
    if not _BACK_REFERENCE.search(pattern):
        for slow, fast in _EDGES:
            pattern = pattern.replace(slow, fast)
    return "(?U)" + pattern


def mask_text(c: Column, rules: Sequence[tuple[str, str]] = MASK_RULES, prefix: str = "<", suffix: str = ">") -> Column:
    """Ordered pattern -> ``prefix + name + suffix``. Patterns see Unicode classes, the replacement is literal."""

    def literal(name: str) -> str:
        return (prefix + name + suffix).replace("\\", "\\\\").replace("$", "\\$")

    return reduce(lambda x, r: F.regexp_replace(x, _for_java(r[0]), literal(r[1])), rules, c)


def mask_messages(df: DataFrame, col: str = "message", rules: Sequence[tuple[str, str]] = MASK_RULES,
                  prefix: str = "<", suffix: str = ">", out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, mask_text(F.col(quoted(col)), rules, prefix, suffix))


def tokens_of(c: Column, delimiters: Sequence[str] = ()) -> Column:
    """T4: delimiters become spaces, then split on runs of white space; empty text has no tokens."""
    single = "".join(dict.fromkeys(d for d in delimiters if len(d) == 1))
    longer = [d for d in delimiters if len(d) > 1]
    if longer:  # these see the single ones as spaces already, but other white space as it is
        c = F.translate(c, single, " " * len(single)) if single else c
        for d in longer:
            c = F.replace(c, F.lit(d), F.lit(" "))
    blanks = "".join(dict.fromkeys(_BLANKS + single))
    return F.array_remove(F.split(F.translate(c, blanks, " " * len(blanks)), " "), "")


def tokenize(df: DataFrame, col: str = "message", delimiters: Sequence[str] = (), out: str = "tokens") -> DataFrame:
    return df.withColumn(out, tokens_of(F.col(quoted(col)), delimiters))


def token_count(tokens: str = "tokens") -> Column:
    """T5: number of tokens."""
    return F.size(quoted(tokens))


def strip_header(df: DataFrame, col: str, sep: str = ": ", out: str | None = None) -> DataFrame:
    """Text after the first ``sep``, empty when there is none."""
    c = F.col(quoted(col))
    at = F.locate(sep, c)
    return df.withColumn(out or col, F.when(at > 0, F.substr(c, at + len(sep))).when(c.isNotNull(), F.lit("")))
