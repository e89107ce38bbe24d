"""Rules as rows: texts meet the rules whose rarest word they hold, and only these rules' patterns are run.

A rule is a row (signal, score, pattern) and its keys, literal pieces that every match holds: whole ASCII words, or runs of
three characters of other scripts. The index has one entry a rule, under its key that the fewest texts hold; so what is
joined and verified follows from the hits, not from texts times rules, and a change of rules is a change of rows.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files

SCHEMA = "rule long, signal string, score double, pattern string, keys array<string>"
#: The most keys of rules that are broadcast to the texts' keys; more are joined by a shuffle.
BROADCAST = 1_000_000
WORD, GRAM = "w:", "g:"


def _alternatives(pattern: str) -> list[str]:
    """The parts of a pattern between bars outside brackets."""
    parts, depth, at = [], 0, 0
    for i, c in enumerate(pattern):
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            parts.append(pattern[at:i])
            at = i + 1
    return [*parts, pattern[at:]]


def keys_of(pattern: str) -> list[str]:
    """Literal pieces that every match of a pattern without bars outside brackets holds."""
    bare = pattern
    while (inner := re.sub(r"\([^()]*\)", "\0", bare)) != bare:
        bare = inner
    whole = pattern.startswith(r"\b") and pattern.endswith(r"\b")
    pieces = re.split(r"\\s[*+]?|\0|\\[bd][*+]?|[.\[\]^$]", bare.removeprefix(r"\b").removesuffix(r"\b"))
    found = []
    for piece in pieces:
        if re.search(r"[\\?*+{}]", piece):
            continue  # not a literal
        if whole and re.fullmatch(r"[a-z0-9_]+", piece):
            found.append(WORD + piece)
        elif len(piece) >= 3:
            found += [GRAM + piece[i : i + 3] for i in range(len(piece) - 2) if not any(c.isascii() for c in piece[i : i + 3])]
    return sorted(set(found))


def rule_rows(signals: Mapping[str, Sequence[tuple[str, float]]]) -> list[tuple[int, str, float, str, list[str]]]:
    """Rules by signal as rows, one for each alternative of ``(a|b)`` or ``\\b(a|b)\\b``; patterns are for lower-case texts."""
    rows = []
    for signal, rules in signals.items():
        for pattern, score in rules:
            bound = r"\b" if pattern.startswith(r"\b") else ""
            inner = pattern.removeprefix(bound).removesuffix(bound)
            if inner.startswith("(") and inner.endswith(")") and not inner.startswith("(?"):
                inner = inner[1:-1]
            for part in _alternatives(inner):
                own = f"{bound}{part}{bound}"
                rows.append((len(rows), signal, float(score), own, keys_of(own)))
    return rows


def rule_table(spark: SparkSession, signals: Mapping[str, Sequence[tuple[str, float]]]) -> DataFrame:
    """:func:`rule_rows` as a frame."""
    return spark.createDataFrame(rule_rows(signals), SCHEMA)


def text_keys(text: Column) -> Column:
    """The distinct keys that a text holds."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(low, F.lit(r"([a-z0-9_]+)"), F.lit(1))
    grams = F.regexp_extract_all(low, F.lit(r"(?=([^\x00-\x7F]{3}))"), F.lit(1))
    tagged = lambda tag, xs: F.transform(F.array_distinct(xs), lambda x: F.concat(F.lit(tag), x))
    return F.concat(tagged(WORD, words), tagged(GRAM, grams))


def hits(texts: DataFrame, rules: DataFrame, key: str, text: str = "ticket_text", broadcast: int = BROADCAST) -> DataFrame:
    """(``key``, rule, signal, score) of all rules whose pattern is found in the lower-cased text; values of ``key`` are unique.

    Raises ValueError where a rule has no key. Null and empty texts hit nothing; equal rules hit each.
    """
    if rules.where(F.size("keys") == 0).limit(1).count():
        raise ValueError("a rule needs a literal word, or three characters of another script, that every match holds")
    wanted = rules.select(F.explode("keys").alias("term")).distinct()
    held = texts.select(key, F.explode(text_keys(F.col(text))).alias("term"))
    # A common key is dealt where the rows are, if the rules' keys can be broadcast.
    small = rules.select(F.sum(F.size("keys"))).first()[0] or 0
    held = files.written(held.join(F.broadcast(wanted) if small <= broadcast else wanted, "term"), "held")
    known = held.groupBy("term").agg(F.count("*").alias("n"))
    # A rule with a key that no text holds hits nothing.
    ranked = rules.select("rule", F.explode("keys").alias("term")).join(known, "term", "left")
    rarest = ranked.groupBy("rule").agg(F.min_by("term", F.struct(F.coalesce("n", F.lit(0)), "term")).alias("term"), F.count_if(F.col("n").isNull()).alias("lost")).where("lost = 0")
    index = rarest.join(rules, "rule").groupBy("term").agg(F.collect_list(F.struct("rule", "signal", "score", "pattern")).alias("found"))
    index = F.broadcast(index) if small <= broadcast else index
    candidates = held.join(index, "term").groupBy(key).agg(F.flatten(F.collect_list("found")).alias("found"))
    verified = texts.select(key, F.lower(F.col(text)).alias("_low")).join(candidates, key).select(key, "_low", F.explode("found").alias("r"))
    return verified.where(F.regexp_like(F.col("_low"), F.col("r.pattern"))).select(key, "r.rule", "r.signal", "r.score")


def signal_scores(texts: DataFrame, rules: DataFrame, key: str, names: Sequence[str], text: str = "ticket_text") -> DataFrame:
    """``key`` and a column for each signal: the highest score of the rules that a text hits, 0 if none."""
    best = hits(texts, rules, key, text).groupBy(key).agg(*[F.max(F.when(F.col("signal") == s, F.col("score"))).alias(f"_{s}") for s in names])
    return texts.select(key).join(best, key, "left").select(key, *[F.coalesce(f"_{s}", F.lit(0.0)).alias(s) for s in names])


def unrolled(rules: list[tuple[int, str, float, str, list[str]]], text: Column, signal: str) -> Column:
    """The same by running every pattern, for few rules."""
    own = sorted((r for r in rules if r[1] == signal), key=lambda r: r[2])
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda score, r: F.when(low.rlike(r[3]), F.lit(r[2])).otherwise(score), own, F.lit(0.0))
