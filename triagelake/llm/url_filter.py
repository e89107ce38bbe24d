"""URL filtering: explicit host and path rules, and association rules mined from labelled URLs.

Spark's FP-growth mines combinations of URL tokens that go with a label; rules below the support and confidence
thresholds, or no better than a rule with fewer of the same tokens, are dropped. Each rule is listed in an inverted
index under its rarest token, so a URL is tried against the rules of its own tokens only. All of it is DataFrame
operations.

FP-growth makes every subset of what rows have in common, 2 to the power of n for n tokens, so transactions are first
rid of what cannot change a rule: tokens that no frequent rule can hold, tokens that alone settle the verdict, and all
but one of tokens that always occur together. Where one still has more than ``WIDE`` tokens, patterns grow by a token a
level instead, over distinct transactions, up to the rules' length; the rules are the same.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHAPE = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LABEL = "verdict="
#: Tokens of a transaction that FP-growth takes whole: it may make 2 ** (WIDE + 1) patterns of one.
WIDE = 12


@dataclass(frozen=True)
class Rule:
    """An explicit rule; it fits its host and all subdomains where the path starts with its path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Mined:
    """URLs with all of ``tokens`` have ``verdict``."""

    tokens: tuple[str, ...]
    verdict: str
    confidence: float
    support: float


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    return F.translate(F.coalesce(F.regexp_extract(url, SHAPE, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or url."""
    return F.coalesce(F.regexp_extract(url, SHAPE, 2), F.lit(""))


def explicit(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, ties by text; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL, each marked by where it stands: scheme, host label, path part, file ending, query key."""
    parts = lambda mark, text, cut: F.transform(F.filter(F.split(text, cut), lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    lower = F.lower(F.coalesce(url, F.lit("")))
    query = F.regexp_replace(F.regexp_extract(lower, r"(?s)\?([^#]*)", 1), r"=[^&]*", "")
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    return F.array_distinct(
        F.concat(
            parts("scheme:", F.regexp_extract(lower, r"(?s)^(.*?)://", 1), "^$"),
            parts("host:", host, r"\."),
            parts("path:", F.lower(path), "/"),
            parts("ending:", F.lower(ending), "^$"),
            parts("query:", query, "&"),
        )
    )


def _grown(rows: DataFrame, least: int, min_confidence: float, longest: int) -> list[Mined]:
    """Rules of up to ``longest`` tokens by growing patterns a token a level; ``rows``: distinct (items, verdict, n).

    A pattern grows on only if it is frequent under a verdict and does not settle it.
    """
    total = rows.agg(F.sum("n")).first()[0]
    level = rows.select("*", F.array().cast("array<string>").alias("pattern"), F.lit(0).alias("at"))
    out: list[Mined] = []
    for _ in range(longest):
        level = level.select("items", "verdict", "n", "pattern", F.explode(F.sequence(F.col("at") + 1, F.size("items"))).alias("at")).where("at <= size(items)")
        level = level.withColumn("pattern", F.concat("pattern", F.array(F.element_at("items", F.col("at")))))
        counts = level.groupBy("pattern", "verdict").agg(F.sum("n").alias("n")).groupBy("pattern").agg(F.sum("n").alias("all"), F.collect_list(F.struct("verdict", "n")).alias("each"))
        counts = counts.where(F.exists("each", lambda e: e["n"] >= least))
        found = counts.collect()  # at most (patterns of a row) / min_support
        for r in found:
            out += [Mined(tuple(r.pattern), e.verdict, e.n / r["all"], e.n / total) for e in r.each if e.n >= least and e.n / r["all"] >= min_confidence]
        alive = [r.pattern for r in found if len(r.each) > 1]
        if not alive:
            break
        level = level.where("at < size(items)").join(rows.sparkSession.createDataFrame([(p,) for p in alive], "pattern array<string>"), "pattern", "left_semi")
    return out


def _by_fpgrowth(rows: DataFrame, min_support: float, min_confidence: float, longest: int) -> list[Mined]:
    """Rules of up to ``longest`` tokens by Spark's FP-growth; ``rows``: (items, verdict), a row a URL."""
    items = rows.select(F.concat("items", F.array(F.concat(F.lit(LABEL), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    found = model.associationRules.where(
        F.element_at("consequent", 1).startswith(LABEL) & (F.size("antecedent") <= longest) & ~F.exists("antecedent", lambda t: t.startswith(LABEL))
    ).select(F.array_sort("antecedent").alias("tokens"), F.element_at("consequent", 1).alias("label"), "confidence", "support")
    return [Mined(tuple(r.tokens), r.label.removeprefix(LABEL), r.confidence, r.support) for r in found.collect()]


def mine(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.8, max_tokens: int = 3) -> list[Mined]:
    """Rules from ``labelled`` (tokens array<string>, verdict string), best first: confidence, support, fewer tokens.

    Every labelled row counts. A rule has at most ``max_tokens`` tokens and none that a better rule with some of the
    same tokens makes needless; of tokens that always occur together the least by name stands for all. What reaches the
    driver is frequent tokens and rules, at most (tokens or patterns of a row) / ``min_support``. Rows with null tokens
    or verdict teach nothing; without rows there are no rules.
    """
    rows = labelled.where("tokens is not null and verdict is not null and size(tokens) > 0").select(F.array_distinct("tokens").alias("tokens"), "verdict")
    distinct = rows.groupBy(F.array_sort("tokens").alias("tokens"), "verdict").agg(F.count("*").alias("n"))
    total = distinct.agg(F.sum("n")).first()[0] or 0
    if not total:
        return []
    least = max(1, math.ceil(total * min_support))
    mark = F.xxhash64("tokens", "verdict").cast("decimal(38,0)")
    each = distinct.select("n", "verdict", mark.alias("m"), F.xxhash64("verdict", "tokens").cast("decimal(38,0)").alias("m2"), F.explode("tokens").alias("token"))
    each = each.groupBy("token", "verdict").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("m2").alias("m2"))
    each = each.groupBy("token").agg(F.sum("n").alias("all"), F.sum("m").alias("m"), F.sum("m2").alias("m2"), F.max(F.struct("n", "verdict")).alias("top")).where(F.col("top.n") >= least)
    tokens = each.groupBy("all", "m", "m2").agg(F.min("token").alias("token"), F.first("top").alias("top")).collect()  # at most tokens of a row / min_support
    mined = [Mined((r.token,), r.top.verdict, 1.0, r.top.n / total) for r in tokens if r.top.n == r["all"]]
    open_ = F.array(*[F.lit(r.token) for r in tokens if r.top.n < r["all"]]).cast("array<string>")
    left = distinct.select(F.array_sort(F.array_intersect("tokens", open_)).alias("items"), "verdict", "n")
    left = left.groupBy("items", "verdict").agg(F.sum("n").alias("n"))
    if left.agg(F.max(F.size("items"))).first()[0] > WIDE:
        mined += _grown(left, least, min_confidence, max_tokens)
    else:
        mined += _by_fpgrowth(rows.select(F.array_intersect("tokens", open_).alias("items"), "verdict"), min_support, min_confidence, max_tokens)
    kept: list[Mined] = []
    seen: dict[str, list[Mined]] = {}
    for m in sorted(mined, key=lambda m: (-m.confidence, -m.support, len(m.tokens), m.tokens)):
        if not any(set(k.tokens) <= set(m.tokens) for t in m.tokens for k in seen.get(t, [])):
            kept.append(m)
            seen.setdefault(m.tokens[0], []).append(m)
    return kept


def evidence(judged: DataFrame, rules: Sequence[Rule], min_support: float = 0.005) -> DataFrame:
    """(tokens, verdict) of ``judged`` (tokens, rule, verdict) for :func:`mine`, without what only restates ``rules``.

    Left out are tokens that a rule itself tests and tokens seen under one rule alone; ones below the support, of which
    there may be many, cannot be mined and go too. The driver gets at most tokens a URL / ``min_support`` of them.
    """
    tested = {f"host:{x}" for r in rules for x in r.host.split(".")} | {f"path:{x.lower()}" for r in rules for x in r.path.split("/") if x}
    least = judged.count() * min_support
    seen = judged.select("rule", F.explode("tokens").alias("token")).where(~F.col("token").isin(*tested) if tested else F.lit(True))
    seen = seen.groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("rule").alias("rules")).where((F.col("n") >= least) & (F.col("rules") > 1))
    told = F.array(*[F.lit(r.token) for r in seen.select("token").collect()]).cast("array<string>")
    return judged.select(F.array_intersect("tokens", told).alias("tokens"), "verdict")


def by_mined(tokens: Column, mined: Sequence[Mined]) -> Column:
    """The verdict of the best rule whose tokens a URL all has; null if there is none."""
    if not mined:
        return F.lit(None).cast("string")
    uses: dict[str, int] = {}
    for m in mined:
        for t in m.tokens:
            uses[t] = uses.get(t, 0) + 1
    index: dict[str, list[int]] = {}
    for i, m in enumerate(mined, 1):
        index.setdefault(min(m.tokens, key=lambda t: (uses[t], t)), []).append(i)
    strings = lambda xs: F.array(*map(F.lit, xs))
    postings = F.create_map(*[x for t, ids in index.items() for x in (F.lit(t), strings(ids))])
    needs, verdicts = F.array(*[strings(m.tokens) for m in mined]), strings([m.verdict for m in mined])
    listed = F.flatten(F.transform(F.filter(tokens, lambda t: F.map_contains_key(postings, t)), lambda t: F.element_at(postings, t)))
    fitting = F.filter(listed, lambda i: F.forall(F.element_at(needs, i), lambda t: F.array_contains(tokens, t)))
    return F.when(F.size(fitting) > 0, F.element_at(verdicts, F.array_min(fitting)))


def judge(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", labels: DataFrame | None = None, **thresholds: float) -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of those names are replaced.

    Explicit rules judge the URLs they fit, mined rules the rest, and ``default`` where none fits. The mined ones learn from ``labels``
    (url, verdict) where there are any, repeated ones each; else the URLs that an explicit rule judges are the labels, by tokens
    that do not restate the rules (:func:`evidence`). Null and shapeless URLs have an empty host and path. Repeated rows are judged each.
    """
    rows = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    e = free_name(rows, "explicit")
    rows = rows.withColumn(e, explicit(F.col("host"), F.col("path"), rules))
    tokens = tokens_of(F.col("url"), F.col("host"), F.col("path"))
    if labels is None:
        judged = rows.where(F.col(e).isNotNull()).select(tokens.alias("tokens"), F.col(f"{e}.rule").alias("rule"), F.col(f"{e}.verdict").alias("verdict"))
        taught = evidence(judged, rules, thresholds.get("min_support", 0.005))
    else:
        taught = labels.select(tokens_of(F.col("url"), host_of(F.col("url")), path_of(F.col("url"))).alias("tokens"), "verdict")
    verdict = F.coalesce(f"{e}.verdict", by_mined(tokens, mine(taught, **thresholds)), F.lit(default))
    return rows.withColumns({"rule": F.col(f"{e}.rule"), "verdict": verdict}).drop(e)
