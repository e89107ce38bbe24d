"""Substring dedup by difference-cover anchors.

A window of ``window`` words goes where the same words also start in a document with a smaller doc_id. Only at
positions whose remainder modulo 7 is in a difference cover are anchors hashed, of ``window`` - 6 words: whatever the
two places of a match, some shift below 7 brings both onto the cover, so any two equal windows share an aligned anchor.
Anchors of one document alone go no further; each other one is extended to the windows around it, and of equal windows
the smallest doc_id keeps its words.

Three packed exchanges carry hashes, never text: anchors to find partners, windows that hold a shared anchor to find
their first document, and what to remove back home. Anchors and windows of so many documents that their postings would
make a partition uneven are spread: such an anchor is taken as shared, and such a window's first document is found by
a minimum that each task takes first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks, rows
from .blocks import Hot, places
from .common import materialize, partitions_for
from .hot import find_in
from .words import hash_words, runs
from .worker import release

PERIOD = 7
#: Every difference modulo 7 is one of two of these.
COVER = np.isin(np.arange(PERIOD), (0, 1, 3))
ANCHOR_WIDTH, WINDOW_WIDTH, BACK_WIDTH = 6, 8, 8
WORD = re.compile(rb"[^\x20\x09-\x0d]+[\x20\x09-\x0d]*")


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def anchors(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of a document's anchors; none if it is shorter than a window."""
    if len(hashes) < window:
        return np.empty(0, int), np.empty(0, np.uint64)
    found = runs(hashes, window - PERIOD + 1)
    at = np.flatnonzero(COVER[np.arange(len(found)) % PERIOD])
    return at, found[at]


def anchors_of(text: str | None, window: int) -> np.ndarray:
    """The distinct anchors of a text."""
    return np.unique(anchors(hash_words(encoded(text)), window)[1])


def windows_of(text: str | None, window: int) -> np.ndarray:
    """The distinct windows of a text."""
    return np.unique(runs(hash_words(encoded(text)), window))


def all_of(texts: list[str | None], each: Callable[[str | None, int], np.ndarray], window: int) -> np.ndarray:
    """The anchors or windows of all texts, one after another."""
    return np.concatenate([np.empty(0, np.uint64), *(each(t, window) for t in texts)])


def _signed(owners: np.ndarray) -> np.ndarray:
    return owners.view(np.int64)


def _anchor_postings(batches: Iterator[pa.RecordBatch], window: int, parts: int, hot: Hot) -> Iterator[pa.RecordBatch]:
    box = blocks.Outbox(parts, ANCHOR_WIDTH, hot)
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if doc_id is not None:
                yield from box.add(doc_id & 0xFFFFFFFFFFFFFFFF, 0, anchors_of(text.as_py(), window))
    yield from box.flush()


def _hot_firsts(batches: Iterator[pa.RecordBatch], window: int, hot: Hot) -> Iterator[pa.RecordBatch]:
    """The least doc_id of each hot window in a task."""
    release()
    least = np.full(len(hot), np.iinfo(np.int64).max)
    seen = np.zeros(len(hot), bool)
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if doc_id is not None:
                at = places(windows_of(text.as_py(), window), hot.tokens)
                at = at[at >= 0]
                least[at], seen[at] = np.minimum(least[at], doc_id), True
    yield pa.RecordBatch.from_arrays([pa.array(hot.tokens[seen].view(np.int64)), pa.array(least[seen])], ["window", "doc_id"])


def hot_firsts(texts: DataFrame, window: int, hot: Hot) -> np.ndarray:
    """The least doc_id of each hot window, in their order; one row for each reaches the driver."""
    if not len(hot):
        return np.empty(0, np.int64)
    rows = texts.mapInArrow(partial(_hot_firsts, window=window, hot=hot), "window long, doc_id long").groupBy("window").agg(F.min("doc_id").alias("low")).collect()
    low = {r.window: r.low for r in rows}
    return np.array([low.get(w, np.iinfo(np.int64).max) for w in hot.tokens.view(np.int64).tolist()], np.int64)


def _home(owners: np.ndarray, short: np.ndarray, width: int, parts: int) -> Iterator[pa.RecordBatch]:
    order = np.argsort(owners, kind="stable")
    owners, short = owners[order], short[order]
    yield from blocks.scatter(owners, np.zeros(len(owners), np.uint32), short, rows.home(owners, parts), width)


def _shared_anchors(batches: Iterator[pa.RecordBatch], parts: int, hot: Hot) -> Iterator[pa.RecordBatch]:
    owners, _, short, _ = blocks.gather(batches, ANCHOR_WIDTH)
    order = np.lexsort((owners, short))
    owners, short = owners[order], short[order]
    if len(short):
        like = short[1:] == short[:-1]
        new = np.concatenate(([True], ~like | (owners[1:] != owners[:-1])))
        owners, short = owners[new], short[new]
        like = short[1:] == short[:-1]
        keep = np.concatenate(([False], like)) | np.concatenate((like, [False])) | (places(short, hot.short(ANCHOR_WIDTH)) >= 0)
        owners, short = owners[keep], short[keep]
    yield from _home(owners, short, ANCHOR_WIDTH, parts)


def _window_postings(batches: Iterator[pa.RecordBatch], window: int, parts: int, hot: Hot) -> Iterator[pa.RecordBatch]:
    known, held = rows.arrivals(batches, ANCHOR_WIDTH)
    box = blocks.Outbox(parts, WINDOW_WIDTH, hot)
    for batch in rows.unpack_rows(held):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            if doc_id is None or not len(shared := known.of(doc_id)):
                continue
            hashes = hash_words(encoded(text.as_py()))
            at, found = anchors(hashes, window)
            at = at[rows.among(blocks.shorten(found, ANCHOR_WIDTH), shared)]
            near = np.zeros(len(hashes) - window + 1, bool)
            for shift in range(PERIOD):
                starts = at - shift
                near[starts[(starts >= 0) & (starts < len(near))]] = True
            yield from box.add(doc_id & 0xFFFFFFFFFFFFFFFF, 0, np.unique(runs(hashes, window)[near]))
    yield from box.flush()


def _later_windows(batches: Iterator[pa.RecordBatch], parts: int, hot: Hot, firsts: np.ndarray) -> Iterator[pa.RecordBatch]:
    owners, _, short, _ = blocks.gather(batches, WINDOW_WIDTH)
    order = np.lexsort((_signed(owners), short))
    owners, short = owners[order], short[order]
    if len(short):
        cuts = np.flatnonzero(np.concatenate(([True], short[1:] != short[:-1])))
        first = np.repeat(owners[cuts], np.diff(np.concatenate((cuts, [len(short)]))))
        if len(hot):
            at = places(short, hot.tokens)
            first[at >= 0] = firsts[at[at >= 0]].view(np.uint64)
        keep = owners != first
        owners, short = owners[keep], short[keep]
    yield from _home(owners, short >> np.uint64(8 * (WINDOW_WIDTH - BACK_WIDTH)), BACK_WIDTH, parts)


def covered(hashes: np.ndarray, gone: np.ndarray, window: int) -> np.ndarray:
    """Which words stand in a window that goes; ``gone``: its sorted short hashes."""
    n = len(hashes)
    edge = np.zeros(n + 1, np.int32)
    if n >= window and len(gone):
        starts = np.flatnonzero(rows.among(blocks.shorten(runs(hashes, window), BACK_WIDTH), gone))
        edge[starts] += 1
        np.subtract.at(edge, starts + window, 1)
    return np.cumsum(edge[:-1]) > 0


def _cut(batches: Iterator[pa.RecordBatch], window: int, keep: list[str], digest: bool) -> Iterator[pa.RecordBatch]:
    known, held = rows.arrivals(batches, BACK_WIDTH)
    for batch in rows.unpack_rows(held):
        counts, gone, results = [], [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py()
            data = encoded(text)
            hashes = hash_words(data)
            mask = covered(hashes, known.of(doc_id) if doc_id is not None else np.empty(0, np.uint64), window)
            counts.append(len(hashes))
            gone.append(int(mask.sum()))
            if digest:
                results.append(hashlib.sha256(b" ".join(compress(data.split(), ~mask))).hexdigest())
            elif gone[-1]:
                results.append(b"".join(compress(WORD.findall(data), ~mask)).rstrip(b" \t\n\v\f\r").decode("utf-8", "surrogatepass"))
            else:
                results.append(text)
        columns = [pa.array(results, pa.string()) if c == "text" and not digest else batch.column(c) for c in keep]
        columns += [pa.array(counts, pa.int64()), pa.array(gone, pa.int64())] + ([pa.array(results, pa.string())] if digest else [])
        yield pa.RecordBatch.from_arrays(columns, [*keep, "n_words", "n_removed", *["kept_sha256"] * digest])


def remove_repeats(docs: DataFrame, window: int = 13, digest: bool = False) -> DataFrame:
    """``docs`` with the words of repeated windows cut from ``text``, and n_words, n_removed.

    Words are maximal runs other than ASCII white space, unchanged; windows are judged on the input. What is kept
    keeps the white space after it; with ``digest`` the result is doc_id, n_words, n_removed and kept_sha256, the
    SHA-256 of the kept words joined by one space. Null texts have no words and texts shorter than ``window`` no
    windows; rows of one doc_id do not cut each other; a null doc_id is neither smaller nor larger than any.
    Columns named n_words, n_removed are replaced; others pass through. An empty table gives no rows.
    """
    if window < PERIOD:
        raise ValueError(f"a window has {PERIOD} words at least")
    parts = partitions_for(docs)
    keep = ["doc_id"] if digest else [c for c in docs.columns if c not in ("n_words", "n_removed")]
    texts = docs.select("doc_id", "text")
    call = lambda f, df, **more: df.mapInArrow(partial(f, parts=parts, **more), blocks.SCHEMA)
    hot_anchors, hot_windows = (find_in(docs.select("text"), partial(all_of, each=f, window=window)) for f in (anchors_of, windows_of))
    firsts = hot_firsts(texts, window, hot_windows)
    posted = call(_anchor_postings, texts, window=window, hot=hot_anchors)
    shared = materialize(call(_shared_anchors, blocks.exchange(posted, parts), hot=hot_anchors), "shared-anchors")
    windows = call(_window_postings, rows.meet(texts, shared, parts), window=window, hot=hot_windows)
    later = materialize(call(_later_windows, blocks.exchange(windows, parts), hot=hot_windows, firsts=firsts), "later-windows")
    fields = [f for f in docs.schema.fields if f.name in keep] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    fields += [T.StructField("kept_sha256", T.StringType())] if digest else []
    source = texts if digest else docs.select(*[f"`{c}`" for c in keep])
    return rows.meet(source, later, parts).mapInArrow(partial(_cut, window=window, keep=keep, digest=digest), T.StructType(fields))
