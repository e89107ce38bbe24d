"""Line dedup by a segment-partition edit join.

Lines of at least ``min_chars`` code points, stripped of ASCII white space, are alike when ``edits`` insertions,
deletions and replacements of code points turn one into the other. A line splits into ``edits + 1`` segments; alike
lines agree in one segment, shifted by no more than the edits around it allow. So each line indexes its segments under
(its length, segment number, content) and probes, for its own and each lesser length, the few substrings that can
match; lines that meet are compared by banded bit-parallel edit distance. Alike lines form classes, links of links
included, and of each class the first line stays, by (doc_id, line number). Shorter lines, if asked for, may differ by
fewer edits, in proportion to the shorter line's length (:func:`allowance`); those too short for one are alike only when
equal and skip the edit join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks, rows
from .blocks import Hot, dealt, places
from .common import materialize, partitions_for
from .hot import find, share_of
from .ngram_join import entry_links, sketch
from .words import BASE, _powers, mix, runs
from .worker import release

WIDTH = 6
INDEXED, PROBED = 1, 2
GRAM = 3
STRIP = b" \t\n\v\f\r"
#: Code points whose substrings are hashed at once, unless one line alone is longer.
CHUNK = 1 << 19
_INVERSE = pow(BASE, -1, 1 << 64)


def lines_of(text: str | None) -> list[bytes]:
    """The lines of a text, each stripped of ASCII white space."""
    return [x.strip(STRIP) for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n")]


def line_id(line: bytes) -> int:
    """The signed 64-bit id of a line."""
    return int(np.array(xxhash.xxh3_64_intdigest(line), np.uint64).astype(np.int64))


def eligible(line: bytes, min_chars: int) -> bool:
    return len(line) >= min_chars and (len(line) >= 4 * min_chars or len(line.decode("utf-8", "surrogatepass")) >= min_chars)


def counted(line: bytes, min_chars: int, exact_short: bool) -> bool:
    """Whether occurrences of a line are looked at: eligible ones, and with ``exact_short`` all that are not blank."""
    return bool(line) if exact_short else eligible(line, min_chars)


def allowance(length, edits: int, min_chars: int):
    """The edits by which lines may differ of which the shorter has ``length`` code points: ``edits`` from ``min_chars`` on, below in proportion."""
    return np.minimum(edits, length * edits // min_chars)


def shortest(edits: int, min_chars: int, scaled: bool) -> int:
    """The least length of a line that takes part in the edit join."""
    return -(-min_chars // edits) if scaled and edits else min_chars


def segment_starts(length: np.ndarray, parts: int) -> list[np.ndarray]:
    """Where each of ``parts`` even segments of lines starts, and the ends; the last segments are the longer."""
    base, longer = length // parts, length % parts
    at, out = np.zeros_like(length), []
    for i in range(parts):
        out.append(at)
        at = at + base + (i >= parts - longer)
    return [*out, at]


def line_entries(lines: list[bytes], edits: int, min_chars: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line number, entry hash, kind) of all index and probe entries of ``lines``; the shorter line sets the number of segments."""
    codes = [np.frombuffer(x.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4") for x in lines]
    length = np.array([len(c) for c in codes], np.int64)
    first = np.cumsum(length) - length
    flat = mix(np.concatenate(codes).astype(np.uint64) + np.uint64(0x51ED27))
    n = len(flat)
    up, down = (_UP, _DOWN) if n < len(_UP) else (_powers(BASE, n + 1), _powers(_INVERSE, n + 1))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(flat * up[:n], out=total[1:])

    def entry(which: np.ndarray, of_length: np.ndarray, segment: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        a = first[which] + start
        content = (total[a + size] - total[a]) * down[a]
        return mix(mix(content + np.uint64(segment)) + of_length.astype(np.uint64))

    who, entries, kinds = [], [], []

    def add(which: np.ndarray, found: np.ndarray, kind: int) -> None:
        who.append(which)
        entries.append(found)
        kinds.append(np.full(len(which), kind, np.uint8))

    for most in range(min(1, edits), edits + 1):
        parts = most + 1
        own = np.flatnonzero(allowance(length, edits, min_chars) == most)
        starts = segment_starts(length[own], parts)
        for i in range(parts):
            add(own, entry(own, length[own], i, starts[i], starts[i + 1] - starts[i]), INDEXED)
        for shorter in range(most + 1):
            other = length - shorter
            probing = (other > 0) & (allowance(other, edits, min_chars) == most)
            theirs = segment_starts(other, parts)
            for i in range(parts):
                size = theirs[i + 1] - theirs[i]
                for shift in range(max(-i, shorter - (most - i)), min(i, shorter + (most - i)) + 1):
                    at = theirs[i] + shift
                    ok = np.flatnonzero((at >= 0) & (at + size <= length) & probing)
                    add(ok, entry(ok, other[ok], i, at[ok], size[ok]), PROBED)
    return np.concatenate(who), np.concatenate(entries), np.concatenate(kinds)


_UP, _DOWN = _powers(BASE, 2 * CHUNK), _powers(_INVERSE, 2 * CHUNK)


def _by_table(a: str, b: str) -> int:
    """The edit distance of short strings."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def within(a: str, b: str, edits: int) -> bool:
    """Whether at most ``edits`` edits turn ``a`` into ``b``.

    After common ends are cut off, a band of 2 * edits + 1 diagonals moves down the table, its vertical differences in
    the bits of two integers; each column costs a few operations whatever the band's width.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    if a == b or not edits:
        return a == b
    if cut := len(commonprefix([a, b])):
        a, b = a[cut:], b[cut:]
    if cut := len(commonprefix([a[::-1], b[::-1]])):
        a, b = a[:-cut], b[:-cut]
    if not a or not b:
        return max(len(a), len(b)) <= edits
    if len(a) > len(b):
        a, b = b, a
    if len(a) <= edits:
        return _by_table(a, b) <= edits
    # Bit i of column j stands for row j - edits + i of ``a``, counted from 1.
    band = 2 * edits + 1
    full, top = (1 << band) - 1, 1 << (band - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << (i + edits)
    up, down, score = (full << edits) & full, 0, edits
    last = 1 << (band - 2)
    flat = len(b) - len(a) + edits  # columns along the last row, the only ones where the count can sink
    for j, c in enumerate(b):
        match = (where.get(c, 0) >> j) & full
        d0 = ((((match & up) + up) ^ up) | match | down) & full
        across_up = (down | ~(d0 | up)) & full
        across_down = d0 & up
        if j + edits < len(a):
            score += not d0 & top
        else:
            score += bool(across_up & last) - bool(across_down & last)
            last >>= 1
        if score > edits + min(len(b) - 1 - j, flat):
            return False
        up = (across_down | ~((d0 >> 1) | across_up)) & full
        down = (d0 >> 1) & across_up
    return score <= edits


def _occurrences(batches: Iterator[pa.RecordBatch], min_chars: int, exact_short: bool, share: float) -> Iterator[pa.RecordBatch]:
    """Every line's id and place; beside them, as ``unit``, the eligible lines of about a ``share`` of the documents."""
    release()
    below = int(share * (1 << 32))
    for batch in batches:
        out: list[list] = [[], [], []]
        units: list[bytes] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if doc_id is not None:
                lines = lines_of(text.as_py())
                for number, line in enumerate(lines):
                    if counted(line, min_chars, exact_short):
                        for column, value in zip(out, (line_id(line), doc_id, number), strict=True):
                            column.append(value)
                if xxhash.xxh32_intdigest(doc_id.to_bytes(8, "little", signed=True)) < below:
                    units += [x for x in set(lines) if eligible(x, min_chars)]
        n = len(out[0])
        columns = [pa.array(c + [None] * len(units), t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32()), strict=True)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([None] * n + units, pa.binary())], ["set_id", "doc_id", "line", "unit"])


def all_entries(lines: list[bytes], edits: int, min_chars: int = 32) -> np.ndarray:
    """The entries that all lines index or probe, each line's own once."""
    if not lines:
        return np.empty(0, np.uint64)
    who, entries, _ = line_entries(lines, edits, min_chars)
    order = np.lexsort((who, entries))
    who, entries = who[order], entries[order]
    return entries[np.concatenate(([True], (entries[1:] != entries[:-1]) | (who[1:] != who[:-1])))]


def _entry_postings(batches: Iterator[pa.RecordBatch], min_chars: int, edits: int, parts: int, hot: Hot, scaled: bool = False) -> Iterator[pa.RecordBatch]:
    release()
    least = shortest(edits, min_chars, scaled)
    held: dict[bytes, None] = {}
    size = 0

    def send() -> Iterator[pa.RecordBatch]:
        if held:
            lines = list(held)
            ids = np.array([line_id(x) for x in lines], np.int64).view(np.uint64)
            who, entries, kinds = line_entries(lines, edits, min_chars)
            order = np.argsort(who, kind="stable")
            who, entries, kinds = who[order], entries[order], kinds[order]
            yield from blocks.scatter(ids[who], np.zeros(len(who), np.uint32), blocks.shorten(entries, WIDTH), dealt(entries, ids[who], hot, parts), WIDTH, kinds)
            held.clear()

    for batch in batches:
        for text in batch.column(0):
            for line in lines_of(text.as_py()):
                if line not in held and eligible(line, least):
                    if size and size + len(line) > CHUNK:
                        yield from send()
                        size = 0
                    held[line] = None
                    size += len(line)
    yield from send()


def _met(batches: Iterator[pa.RecordBatch], hot: Hot) -> Iterator[pa.RecordBatch]:
    """Lines and entries that one line indexes and another probes. Of hot entries, whose postings are spread, all lines,
    with what each does (``kind``, else 0)."""
    owners, _, short, kinds = blocks.gather(batches, WIDTH)
    if not len(short):
        return
    order = np.lexsort((owners, short))
    owners, short, kinds = owners[order], short[order], kinds[order]
    own = np.flatnonzero(np.concatenate(([True], (short[1:] != short[:-1]) | (owners[1:] != owners[:-1]))))
    owners, short, kinds = owners[own], short[own], np.bitwise_or.reduceat(kinds, own)
    cuts = np.flatnonzero(np.concatenate(([True], short[1:] != short[:-1])))
    lines = np.diff(np.concatenate((cuts, [len(short)])))
    spread = np.repeat(places(short[cuts], hot.short(WIDTH)) >= 0, lines)
    keep = spread | np.repeat((np.bitwise_or.reduceat(kinds, cuts) == INDEXED | PROBED) & (lines > 1), lines)
    kind = np.where(spread, kinds, 0).astype(np.int8)
    yield pa.RecordBatch.from_arrays([pa.array(owners[keep].view(np.int64)), pa.array(short[keep].astype(np.int64)), pa.array(kind[keep])], ["set_id", "entry", "kind"])


def _settled(met: DataFrame, hot: Hot) -> DataFrame:
    """(set_id, entry): what :func:`_met` found, of hot entries those that some line indexes; probes alone meet nothing."""
    if not len(hot):
        return met.select("set_id", "entry")
    indexed = met.where(F.col("kind").bitwiseAND(INDEXED) != 0).select("entry").distinct()
    return met.where("kind = 0").select("set_id", "entry").unionByName(met.where("kind <> 0").join(indexed, "entry", "left_semi").select("set_id", "entry"))


def _marks(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").to_numpy().view(np.uint64)
        tokens = (batch.column("line").to_numpy().astype(np.uint64) << np.uint64(32)) | (batch.column("set_id").to_numpy().view(np.uint64) >> np.uint64(32))
        order = np.argsort(ids, kind="stable")
        yield from blocks.scatter(ids[order], np.zeros(len(ids), np.uint32), tokens[order], rows.home(ids[order], parts), 8)


def _at_home(docs: DataFrame, occurrences: DataFrame, parts: int) -> DataFrame:
    """Documents beside the (line, set_id) that ``occurrences`` name in them."""
    return rows.meet(docs, occurrences.select("doc_id", "line", "set_id").mapInArrow(partial(_marks, parts=parts), blocks.SCHEMA), parts)


def _marked(known: rows.Postings, doc_id: int | None) -> dict[int, set[int]]:
    found: dict[int, set[int]] = {}
    for t in known.of(doc_id).tolist() if doc_id is not None else ():
        found.setdefault(t >> 32, set()).add(t & 0xFFFFFFFF)
    return found


def _is_marked(found: dict[int, set[int]], number: int, line: bytes) -> bool:
    return number in found and (line_id(line) & 0xFFFFFFFFFFFFFFFF) >> 32 in found[number]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, held = rows.arrivals(batches, 8)
    for batch in rows.unpack_rows(held):
        out: list[list] = [[], [], [], [], []]
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            if found := _marked(known, doc_id):
                lines = lines_of(text.as_py())
                for number in found:
                    if number < len(lines) and _is_marked(found, number, lines[number]):
                        grams = grams_of(lines[number])
                        row = (line_id(lines[number]), len(lines[number].decode("utf-8", "surrogatepass")), len(grams), sketch(grams, 16), lines[number])
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["set_id", "n", "size", "sketch", "tokens"])


def grams_of(line: bytes) -> np.ndarray:
    """The distinct hashes of ``GRAM`` consecutive code points."""
    codes = np.frombuffer(line.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return np.unique(runs(mix(codes), GRAM))


def edits_allow(edits: int, a_n, a_size, a_alone, b_n, b_size, b_alone):
    """Whether two lines can be alike: an edit takes at most ``GRAM`` grams from either."""
    return (a_alone <= GRAM * edits) & (b_alone <= GRAM * edits) & (np.abs(a_n - b_n) <= edits)


def _alike(a: bytes, b: bytes, a_n: int, b_n: int, edits: int, min_chars: int) -> bool:
    return within(a.decode("utf-8", "surrogatepass"), b.decode("utf-8", "surrogatepass"), int(allowance(min(a_n, b_n), edits, min_chars)))


def _cut(batches: Iterator[pa.RecordBatch], keep: list[str], digest: bool) -> Iterator[pa.RecordBatch]:
    known, held = rows.arrivals(batches, 8)
    for batch in rows.unpack_rows(held):
        counts, gone, results = [], [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py()
            raw = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
            found = _marked(known, doc_id)
            left = [x for i, x in enumerate(raw) if not (i in found and _is_marked(found, i, x.strip(STRIP)))] if found else raw
            counts.append(len(raw) if text is not None else 0)
            gone.append(len(raw) - len(left))
            kept = b"\n".join(left)
            results.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "surrogatepass") if gone[-1] else text)
        columns = [pa.array(results, pa.string()) if c == "text" and not digest else batch.column(c) for c in keep]
        columns += [pa.array(counts, pa.int64()), pa.array(gone, pa.int64())] + ([pa.array(results, pa.string())] if digest else [])
        yield pa.RecordBatch.from_arrays(columns, [*keep, "n_lines", "n_cut", *["kept_sha256"] * digest])


def line_classes(docs: DataFrame, edits: int = 2, min_chars: int = 32, exact_short: bool = False, scaled: bool = False) -> DataFrame:
    """(set_id, doc_id, line, first_doc, first_line): every eligible line whose class holds another occurrence.

    ``first_doc`` and ``first_line`` name the class by its first occurrence; lines alone in their class are left out.
    With ``scaled`` shorter lines join within their :func:`allowance`; with ``exact_short`` those without one are there
    too, in classes of equal lines; they index and probe nothing.
    """
    least = shortest(edits, min_chars, scaled)
    parts = partitions_for(docs)
    texts = docs.select("doc_id", "text")
    place = partial(_occurrences, min_chars=least, exact_short=exact_short, share=share_of(docs))
    seen = materialize(texts.mapInArrow(place, "set_id long, doc_id long, line int, unit binary"), "lines")
    # Entries of so many different lines that their postings are dealt by line, too.
    hot = find(seen.where("unit is not null").select("unit"), partial(all_entries, edits=edits, min_chars=min_chars), distinct=True, parts=parts)
    seen = seen.where("set_id is not null").select("set_id", "doc_id", "line")
    posted = texts.where("doc_id is not null").select("text").mapInArrow(partial(_entry_postings, min_chars=min_chars, edits=edits, parts=parts, hot=hot, scaled=scaled), blocks.SCHEMA)
    entries = _settled(materialize(blocks.exchange(posted, parts).mapInArrow(partial(_met, hot=hot), "set_id long, entry long, kind byte"), "met"), hot)
    wanted = seen.join(materialize(entries.select("set_id").distinct(), "wanted"), "set_id")
    wanted = materialize(wanted.groupBy("set_id").agg(F.min(F.struct("doc_id", "line")).alias("at")).select("set_id", "at.*"), "firsts")
    sets = materialize(_at_home(texts, wanted, parts).mapInArrow(_texts, "set_id long, n int, size int, sketch binary, tokens binary").dropDuplicates(["set_id"]), "line-texts")
    sized = materialize(entries.join(sets.select("set_id", "n"), "set_id").withColumn("lone", F.lit(0)), "sized")
    need = GRAM * edits + 1  # an edit takes at most GRAM grams
    found = entry_links(sized, sets, f"abs(a_n - b_n) <= {edits}", partial(edits_allow, edits), partial(_alike, edits=edits, min_chars=min_chars), grams_of, str(need), f"size >= {need}")
    found = materialize(found, "found")
    classes = seen.groupBy("set_id").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("c"))
    classes = materialize(classes.join(found.withColumnRenamed("node", "set_id"), "set_id", "left").where("c > 1 or component is not null"), "classes")
    lows = materialize(classes.where("component is not null").groupBy("component").agg(F.min("first").alias("low")), "class-firsts")
    named = classes.join(lows, "component", "left").select("set_id", F.coalesce("low", "first").alias("low"))
    named = materialize(named.select("set_id", F.col("low.doc_id").alias("first_doc"), F.col("low.line").alias("first_line")), "named")
    return seen.join(named, "set_id")


def remove_lines(docs: DataFrame, edits: int = 2, min_chars: int = 32, digest: bool = False, exact_short: bool = False, scaled: bool = False) -> DataFrame:
    """``docs`` without the lines that are alike with an earlier one, and n_lines, n_cut.

    Lines end at newlines; shorter lines than ``min_chars`` are left alone. With ``scaled`` they are alike within fewer
    edits, ``edits`` * length / ``min_chars`` rounded down (one edit from 16 of 32 characters on); with ``exact_short`` those
    that no edit is allowed for are alike when equal (blank ones stay). Judged on the input: every occurrence
    after its class's first, by (doc_id, line number from 0), goes, with its newline. With ``digest`` the result is
    doc_id, n_lines, n_cut and kept_sha256, the SHA-256 of what is kept. A null text has no lines and stays null; rows of
    one doc_id are alike in place, so neither is the earlier; a null doc_id keeps all its lines. Columns named n_lines,
    n_cut are replaced; others pass through. An empty table gives no rows.
    """
    parts = partitions_for(docs)
    later = line_classes(docs, edits, min_chars, exact_short, scaled).where("first_doc < doc_id or (first_doc = doc_id and first_line < line)")
    later = materialize(later.select("doc_id", "line", "set_id"), "later-lines")
    keep = ["doc_id"] if digest else [c for c in docs.columns if c not in ("n_lines", "n_cut")]
    fields = [f for f in docs.schema.fields if f.name in keep] + [T.StructField("n_lines", T.LongType()), T.StructField("n_cut", T.LongType())]
    fields += [T.StructField("kept_sha256", T.StringType())] if digest else []
    source = docs.select("doc_id", "text") if digest else docs.select(*[f"`{c}`" for c in keep])
    return _at_home(source, later, parts).mapInArrow(partial(_cut, keep=keep, digest=digest), T.StructType(fields))
