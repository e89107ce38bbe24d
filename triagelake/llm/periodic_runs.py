"""Periodic runs of words: every maximal repetition of a text, and the text without the repeats.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and at least 2 * q words
that no neighbouring word extends keeping period q. They are found from the longest-previous-factor (LPF) array:

* the suffix array of the words comes from prefix doubling; the classes of equal blocks of 1, 2, 4, ... words that
  it makes on its way also tell how far two places agree, forward and backward;
* its LCP array and a stack give LPF: for each place the longest match with an earlier one, and where that is;
* LPF gives the Lempel-Ziv blocks;
* a run that touches a block's bound is found there by Main's extensions: of a place next to the bound and the place
  one period away, as far as words agree in both directions;
* a run strictly inside a block is a copy of one inside the block's earlier match, and is copied from there, runs
  being held in buckets by their first word.

Texts are handled many at a time in one sequence: words of different texts have different numbers, so nothing matches
across them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import free_name
from .tokenize import batches

#: Bytes of text that are handled as one sequence, unless one text is longer.
TOGETHER = 1_000_000
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def block_classes(words: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Classes of equal blocks of 1, 2, 4, ... words by their start, as long as any two are equal; and each suffix's rank.

    A class is numbered by the rank of its first suffix. Only suffixes that still share a class are sorted on.
    A last entry of -1 stands for the end.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    new = np.ones(n, bool)
    new[1:] = words[order[1:]] != words[order[:-1]]
    at = np.arange(n)
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))
    alone = new & np.append(new[1:], True)
    open_ = order[~alone]
    levels, width = [], 1
    while len(open_):
        levels.append(rank.astype(np.int32) if n < 1 << 31 else rank.copy())
        own = rank[open_]
        key = own * (n + 2) + rank[np.minimum(open_ + width, n)] + 1
        order = np.argsort(key, kind="stable")
        open_, own, key = open_[order], own[order], key[order]
        new = np.ones(len(open_), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.ones(len(open_), bool)
        first[1:] = own[1:] != own[:-1]
        at = np.arange(len(open_))
        rank[open_] = own + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(first, at, 0))
        open_ = open_[~(new & np.append(new[1:], True))]
        width *= 2
    return levels, rank[:n]


def agree_ahead(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words from ``a`` on equal those from ``b`` on, for pairs of different places."""
    total = np.zeros(len(a), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        total += (levels[j][a + total] == levels[j][b + total]).astype(np.int64) << j
    return total


def agree_behind(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words before ``a`` equal those before ``b``, for pairs with a < b."""
    total = np.zeros(len(a), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        x, y = a - total - (1 << j), b - total - (1 << j)
        total += ((levels[j][np.maximum(x, 0)] == levels[j][np.maximum(y, 0)]) & (x >= 0)).astype(np.int64) << j
    return total


def previous_factors(levels: list[np.ndarray], rank: np.ndarray) -> tuple[list[int], list[int]]:
    """LPF and a place of the earlier match (-1: none) of each place, from suffix and LCP arrays.

    A stack holds suffixes with rising places; a suffix is settled by the nearest ones of smaller place on both sides.
    """
    n = len(rank)
    lpf, source = [0] * n, [-1] * n
    if not levels:
        return lpf, source
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    alike = np.flatnonzero(levels[0][suffix[1:]] == levels[0][suffix[:-1]])
    lcp[alike + 1] = agree_ahead(levels, suffix[alike], suffix[alike + 1])
    kept = np.flatnonzero((lcp > 0) | (np.append(lcp[1:], 0) > 0))
    places, shared = [-1], [0]  # a bottom that is never settled
    for place, common in zip(suffix[kept].tolist(), lcp[kept].tolist(), strict=True):
        while places[-1] > place:
            top, own = places.pop(), shared.pop()
            if own >= common:
                lpf[top], source[top], common = own, places[-1], common
            else:
                lpf[top], source[top], common = common, place, own
        places.append(place)
        shared.append(common)
    while len(places) > 1:
        top = places.pop()
        lpf[top], source[top] = shared.pop(), places[-1]
    return lpf, source


def blocks_of(lpf: list[int]) -> np.ndarray:
    """Where the Lempel-Ziv blocks start, and the end: each is as long as its start's match, or one word."""
    out, at, n = [], 0, len(lpf)
    while at < n:
        out.append(at)
        at += lpf[at] or 1
    return np.array([*out, n], np.int64)


def _at_bounds(levels: list[np.ndarray], bounds: np.ndarray, least: int) -> np.ndarray:
    """(start, end, period) of runs that touch a block's bound; a period may be a multiple of the smallest."""
    size = np.append(np.diff(bounds), 0)
    before = np.append(0, size[:-1])
    found = []
    for counts, ahead in ((size, True), (np.minimum(before + size, bounds), False)):
        bound = np.repeat(bounds, counts)
        period = np.arange(len(bound)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
        a = bound if ahead else bound - period
        b = a + period
        # At least three words must agree on one side of the bound (least is 6 or more), so two next to it do.
        n = len(levels[0]) - 1
        ok = levels[1][np.minimum(a, n)] == levels[1][np.minimum(b, n)]
        ok |= (a >= 2) & (levels[1][np.maximum(a - 2, 0)] == levels[1][np.minimum(b - 2, n)])
        a, b, period = a[ok], b[ok], period[ok]
        ok = b <= n
        a, b, period = a[ok], b[ok], period[ok]
        after, back = agree_ahead(levels, a, b), agree_behind(levels, a, b)
        ok = after + back >= np.maximum(period, least - period)
        found.append(np.stack([a[ok] - back[ok], b[ok] + after[ok], period[ok]], 1))
    return np.concatenate(found)


def runs_of(words: np.ndarray, least: int = 12) -> np.ndarray:
    """(start, length, period) of every run of at least ``max(least, 2 * period)`` words, by start, then period.

    ``words`` are numbers, equal for equal words. ``least`` must be 6 at least.
    """
    if least < 6:
        raise ValueError("runs of fewer than six words are not looked for")
    none = np.empty((0, 3), np.int64)
    if len(words) < least:
        return none
    levels, rank = block_classes(words)
    if len(levels) < 2:  # no two words come twice side by side
        return none
    lpf, source = previous_factors(levels, rank)
    bounds = blocks_of(lpf)
    found = _at_bounds(levels, bounds, least)
    if not len(found):
        return none
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    found = found[np.append(True, (found[1:, :2] != found[:-1, :2]).any(1))]  # the smallest period of each stretch
    buckets: dict[int, list[tuple[int, int]]] = {}
    for start, end, period in found.tolist():
        buckets.setdefault(start, []).append((end, period))
    for at in bounds[:-1][np.diff(bounds) > least].tolist():
        size, came = lpf[at], source[at]
        for start in range(came + 1, came + size - least):
            for end, period in buckets.get(start, ()):
                if end < came + size:
                    buckets.setdefault(start + at - came, []).append((end + at - came, period))
    rows = [(start, end - start, period) for start, some in buckets.items() for end, period in some]
    return np.array(sorted(rows, key=lambda r: (r[0], r[2])), np.int64)


def _repeated(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words a run holds after its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(step[:n]) > 0


def _collapse(texts: list[bytes | None], least: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """The runs of each text and its words without repeats."""
    split = [(t or b"").split() for t in texts]
    numbers, known = [], 0
    for words in split:
        distinct = dict(zip(dict.fromkeys(words), range(known, known + len(words)), strict=False))
        known += len(distinct)
        numbers.append(np.fromiter(map(distinct.__getitem__, words), np.int64, len(words)))
    found = runs_of(np.concatenate([np.empty(0, np.int64), *numbers]), least)
    ends = np.cumsum([len(w) for w in split])
    cuts = np.searchsorted(found[:, 0], np.concatenate([[0], ends]))
    for i, words in enumerate(split):
        own = found[cuts[i] : cuts[i + 1]]
        if len(own):
            own = own - np.array([ends[i] - len(words), 0, 0])
            words = [w for w, gone in zip(words, _repeated(own, len(words)).tolist(), strict=True) if not gone]
        yield own, b" ".join(words)


def _run_batches(rows: Iterator[pa.RecordBatch], keep: int, least: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    kind = schema.field(keep).type.value_type
    for batch in rows:
        texts = batch.column(keep).cast(pa.binary())
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        for some in batches([range(s) for s in sizes], TOGETHER):
            part = batch.slice(some.start, some.stop - some.start)
            found = list(_collapse(texts[some.start : some.stop].to_pylist(), least))
            flat = np.concatenate([np.empty((0, 3), np.int64), *[r for r, _ in found]])
            fields = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(kind))
            offsets = np.cumsum([0, *[len(r) for r, _ in found]])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), fields, type=schema.field(keep).type)
            collapsed = pa.array([t for _, t in found], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns[:keep], lists, collapsed], schema=schema)


def find_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """``docs`` with ``runs`` of every whole ``text`` and ``collapsed``, its words outside repeats.

    runs: (start, length, period) in words (runs of characters other than ASCII white space, numbered from 0), of all runs of
    at least ``max(least, 2 * period)`` words, by start, then period. A word that a run holds after its first period is
    a repeat; the others stay, joined by one space. A null, empty or blank text has no runs and collapses to the empty text.
    Repeated rows are handled each; an empty table gives none; columns of those two names are replaced, all others,
    null or not, pass through unread. A text is handled whole by one task, in memory proportional to its words.
    """
    keep = [c for c in docs.columns if c not in ("runs", "collapsed")]
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("runs", T._parse_datatype_string(f"array<{RUN}>")), T.StructField("collapsed", T.StringType())])
    arrow = to_arrow_schema(schema)
    text = free_name(docs, "text_of_runs")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias(text))
    return rows.mapInArrow(partial(_run_batches, keep=len(keep), least=least, schema=arrow), schema)


def run_digest(rows: DataFrame) -> DataFrame:
    """Per row of :func:`find_runs`: doc_id, n_runs, the longest run, and digests of all runs and of the collapsed text."""
    longest = F.try_element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), F.lit(1))
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    rows = rows.withColumn(best := free_name(rows, "longest"), longest)
    start, length, period = F.col(f"{best}.s"), -F.col(f"{best}.l"), F.col(f"{best}.p")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.expr(f"(1000 * -{best}.l) div {best}.p").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(listed, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_runs(doc_id: Column, text: Column) -> Column:
    """The text's words, of about one document in ten with a periodic end planted by a hash of ``doc_id``.

    Let h be the CRC-32 of the decimal doc_id and g = floor(h / 10). If h % 10 is 0, each word i >= a becomes word
    a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). Other texts, and those of a null
    doc_id, stay as they are; null counts as empty.
    """
    whole = F.coalesce(text, F.lit(""))
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split(whole, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), n - a)
    return F.when(h % 10 == 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(whole)
