"""Secrets in texts: patterned ones by regular expressions, others by the entropy of sliding windows.

A window of ``WINDOW`` characters slides over each candidate, a run of token characters. Per window the count of every
character is kept by adding one and removing one, and with it the sum of c * log2(c), in whole units of 2**-40, so
that no rounding adds up: Shannon's entropy is log2(WINDOW) less that sum over WINDOW. A window that lies in one character
class, holds the kinds of characters that the class asks for and reaches its entropy is a find; windows that touch make one
span. Candidates on the allow-list, and spans that touch a patterned one, are not reported.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import free_name

# The patterned kinds. ``least`` is the length that group 2, or the whole match, must have.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 6
#: These match whole runs only, so the least length can stand in the pattern: what it passes over holds no match.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
PATTERNED = ("assign", "access", "hex")

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % WINDOW)
SCALE = 40
#: c * log2(c) in units of 2**-SCALE
SPREAD = [0] + [round(c * math.log2(c) * (1 << SCALE)) for c in range(1, WINDOW + 2)]


@dataclass(frozen=True)
class CharClass:
    """A character class: a window in it needs ``bits`` of entropy and so many digits, lower- and upper-case letters."""

    name: str
    members: str
    bits: float
    digits: int = 0
    lower: int = 0
    upper: int = 0


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Random windows have about 3.5 bits in 16 characters, 3.8 in 36 and 4.0 in 64; words in lower case stay below 3.6 as a rule.
CLASSES = (
    CharClass("lower_hex", DIGITS + LOWER[:6], 3.0, digits=2, lower=2),
    CharClass("upper_hex", DIGITS + UPPER[:6], 3.0, digits=2, upper=2),
    CharClass("lower_alnum", DIGITS + LOWER, 3.6, digits=3, lower=3),
    CharClass("upper_alnum", DIGITS + UPPER, 3.6, digits=3, upper=3),
    CharClass("base64", DIGITS + LOWER + UPPER + "+/_-", 3.8, digits=1, lower=2, upper=2),
)
#: Candidates that hold one of these are no secrets: identifiers in UUID form, alphabets in order, placeholders; and those that are
#: a web address's or a path's end, by what stands before them.
ALLOW = (
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    r"0123456789|(?i:abcdefghij|qwertyuiop)",
    r"(?i:example|sample|placeholder|changeme|dummy|redacted|xxxxxx)",
)
BEFORE = r"(?:://|www\.|[\w.-]+\.[a-z]{2,}/|\./|\b[A-Za-z]:\\)[^\s\"'<>]*$"
SPAN = "struct<kind:string,start:int,end:int>"


def patterned(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterned secrets, leftmost and not overlapping within a kind; in order of start, then kind."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, PATTERNED[k]) for a, b, k in sorted(found, key=lambda s: (s[0], s[2]))]


@lru_cache(maxsize=8)
def _tables(classes: tuple[CharClass, ...]) -> tuple[dict[str, int], list[tuple[int, str, int, int, int, int]]]:
    """The classes that each character is not in, as bits; and of each class its bit, name, most spread and needs."""
    outside = {c: sum(1 << i for i, k in enumerate(classes) if c not in k.members) for c in DIGITS + LOWER + UPPER + "+/_-"}
    most = [math.floor((math.log2(WINDOW) - k.bits) * WINDOW * (1 << SCALE)) for k in classes]
    return outside, [(1 << i, k.name, m, k.digits, k.lower, k.upper) for i, (k, m) in enumerate(zip(classes, most, strict=True))]


def entropic(candidate: str, classes: tuple[CharClass, ...] = CLASSES) -> list[tuple[int, int, str]]:
    """(start, end, class) of the stretches of a candidate that windows of high entropy cover; the class is its first window's."""
    outside, rules = _tables(classes)
    loosest = max(r[2] for r in rules)
    counts: dict[str, int] = dict.fromkeys(outside, 0)
    last_out = [-1] * len(classes)
    spread = digits = lower = upper = 0
    spans: list[tuple[int, int, str]] = []
    for i, c in enumerate(candidate):
        n = counts[c]
        counts[c] = n + 1
        spread += SPREAD[n + 1] - SPREAD[n]
        if c in DIGITS:
            digits += 1
        elif c in LOWER:
            lower += 1
        elif c in UPPER:
            upper += 1
        if out := outside[c]:
            for k in range(len(rules)):
                if out >> k & 1:
                    last_out[k] = i
        start = i + 1 - WINDOW
        if start > 0:
            old = candidate[start - 1]
            n = counts[old]
            counts[old] = n - 1
            spread += SPREAD[n - 1] - SPREAD[n]
            if old in DIGITS:
                digits -= 1
            elif old in LOWER:
                lower -= 1
            elif old in UPPER:
                upper -= 1
        if start >= 0 and spread <= loosest:
            for k, (_, name, most, d, lo, up) in enumerate(rules):
                if spread <= most and last_out[k] < start and digits >= d and lower >= lo and upper >= up:
                    if spans and start <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], i + 1, spans[-1][2])
                    else:
                        spans.append((start, i + 1, name))
                    break
    return spans


def secrets_of(text: str, allow: re.Pattern, before: re.Pattern, classes: tuple[CharClass, ...] = CLASSES) -> list[tuple[int, int, str]]:
    """All spans of a text, by start, then kind: the patterned ones, and those of high entropy that touch none of them."""
    found = patterned(text)
    extra = []
    for m in CANDIDATE.finditer(text):
        spans = entropic(m.group(), classes)
        if spans and not allow.search(m.group()) and not before.search(text, max(0, m.start() - 200), m.start()):
            extra += [(m.start() + a, m.start() + b, name) for a, b, name in spans]
    if not extra:
        return found
    # Patterned spans of one kind do not overlap, but ends of different kinds can be out of order: compare with the furthest one so far.
    merged, at, reach = [], 0, -1
    for a, b, name in extra:
        while at < len(found) and found[at][0] < b:
            reach = max(reach, found[at][1])
            at += 1
        if reach <= a:
            merged.append((a, b, name))
    names = [*PATTERNED, *(k.name for k in classes)]
    return sorted(found + merged, key=lambda s: (s[0], names.index(s[2])))


def _scan(rows: Iterator[pa.RecordBatch], keep: int, schema: pa.Schema, allow: str, before: str, classes: tuple[CharClass, ...]) -> Iterator[pa.RecordBatch]:
    allowed, address = re.compile(allow), re.compile(before, re.ASCII)
    kind = schema.field(keep).type
    for batch in rows:
        found = [secrets_of(t.as_py() or "", allowed, address, classes) for t in batch.column(keep)]
        flat = [s for some in found for s in some]
        columns = [pa.array([s[2] for s in flat], pa.string()), pa.array([s[0] for s in flat], pa.int32()), pa.array([s[1] for s in flat], pa.int32())]
        offsets = [0]
        for some in found:
            offsets.append(offsets[-1] + len(some))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(kind.value_type)), type=kind)
        yield pa.RecordBatch.from_arrays([*batch.columns[:keep], lists], schema=schema)


def find_secrets(docs: DataFrame, allow: tuple[str, ...] = ALLOW, before: str = BEFORE, classes: tuple[CharClass, ...] = CLASSES) -> DataFrame:
    """``docs`` with ``secrets``, all spans of secrets in every whole ``text``: kind, start and end in code points, the end outside.

    Kinds are ``assign``, ``access`` and ``hex`` for patterned secrets, else the name of the class whose windows are of high entropy;
    spans are ordered by start, then by kind. ``allow`` and ``before`` suppress candidates of the latter kind alone.
    A null or empty text has no secrets. Repeated rows are scanned each; an empty table gives none; a column ``secrets`` is
    replaced, all others, null or not, pass through unread. Work grows with the characters of a text, however long.
    """
    keep = [c for c in docs.columns if c != "secrets"]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("secrets", T._parse_datatype_string(f"array<{SPAN}>"))])
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias(free_name(docs, "text_of_secrets")))
    joined = "|".join(f"(?:{a})" for a in allow) or r"(?!)"
    return rows.mapInArrow(partial(_scan, keep=len(keep), schema=to_arrow_schema(schema), allow=joined, before=before, classes=classes), schema)


def redact(rows: DataFrame, by: str = "[secret]") -> DataFrame:
    """Rows of :func:`find_secrets` with each stretch of the text that spans cover replaced by ``by``; a null text stays null."""
    pieces = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("text")
    step = F.aggregate(
        "secrets", pieces,
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(x["start"] < s["at"], s["out"]).otherwise(F.concat(s["out"], text.substr(s["at"] + 1, x["start"] - s["at"]), F.lit(by))).alias("out"),
        ),
        lambda s: F.concat(s["out"], text.substr(s["at"] + 1, F.length(text))),
    )
    return rows.withColumn("text", F.when(F.size("secrets") > 0, step).otherwise(text))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(rows: DataFrame) -> DataFrame:
    """Per row of :func:`find_secrets`: doc_id, how many spans of each patterned kind, a digest of those, and all spans as text."""
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin(*PATTERNED))
    return rows.select("doc_id", *map(count, PATTERNED), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))
