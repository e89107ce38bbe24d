"""N-gram Jaccard join by token-combination prefixes.

A document's set holds its distinct 5-word shingles as 64-bit hashes; equal sets form a class, and classes join.

Shingles are ordered from rare to frequent. A class can lack at most ``n - ceil(p n)`` of its shingles in a class
that it links with, so in a prefix that would cost a partner one more than that, something is shared. Rare shingles
are indexed singly. Frequent ones fall into groups by hash and are indexed in pairs of one group: a partner that
shares no pair keeps at most one of a group's shingles, so a group of g costs it g - 1, and the prefix is extended by
one shingle per group. The number of groups follows from the sizes that can match, which also keeps the number of
pairs in proportion to the prefix. Shingles of one class alone cost a partner all of them: a class with enough of
those can have no link and goes no further.

Only classes with the same index entry are compared: first each with one leader, then, as what is linked already need
not be compared, all pairs that are in different components yet. Where many sets are left to compare, their prefixes are
taken again, ordered by what is frequent among just these. A bitmap of each set bounds what two sets can share, so that
few pairs come to the final comparison of their tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .blocks import Hot, places
from .common import drop_written, materialize, partitions, partitions_for
from .graph import connected_components
from .hot import find_in
from .words import hash_words, mix, runs, whole
from .worker import release

WIDTH = 6
#: Shingles in more classes than 2 to this power count as frequent.
FREQUENT = 6


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of ``k`` consecutive words, A-Z lower-cased; of all words, if there are fewer."""
    words = hash_words((text or "").encode("utf-8", "surrogatepass"), lower=True)
    if not len(words):
        return words
    return np.unique(runs(words, k)) if len(words) >= k else whole(words)


def unpacked(tokens: bytes) -> np.ndarray:
    """The tokens that a set shares with others."""
    return blocks._unpack(np.frombuffer(tokens, np.uint8), WIDTH)


def shingles_of(texts: list[str | None], k: int) -> np.ndarray:
    """The sets of all texts, one after another."""
    return np.concatenate([np.empty(0, np.uint64), *(shingle_set(t, k) for t in texts)])


def class_of(tokens: np.ndarray) -> int:
    """The 64-bit id of a set."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes())


def _members(rows: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    release()
    for batch in rows:
        ids, sizes = [], []
        for text in batch.column(1):
            tokens = shingle_set(text.as_py(), k)
            sizes.append(len(tokens))
            ids.append(int(np.array(class_of(tokens), np.uint64).astype(np.int64)) if len(tokens) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())], ["doc_id", "set_id", "n_shingles"])


def _postings(rows: Iterator[pa.RecordBatch], k: int, parts: int, least: int, hot: Hot) -> Iterator[pa.RecordBatch]:
    box, seen = blocks.Outbox(parts, WIDTH, hot), set()
    for batch in rows:
        for text in batch.column(0):
            tokens = shingle_set(text.as_py(), k)
            if len(tokens) < least or (owner := class_of(tokens)) in seen:
                continue
            seen.add(owner)
            yield from box.add(owner, len(tokens), tokens)
            if not box.held:
                seen.clear()
    yield from box.flush()


def hot_ranks(hot: Hot, sets: int) -> np.ndarray:
    """A rank above ``FREQUENT`` for each hot token, by how many of ``sets`` hold it; the same in every task."""
    return np.maximum(FREQUENT + 1, np.ceil(np.log2(np.maximum(hot.shares * sets, 1)))).astype(np.uint8)


def _shared(rows: Iterator[pa.RecordBatch], parts: int, hot: Hot, sets: int) -> Iterator[pa.RecordBatch]:
    """Postings of tokens in more than one set, to their owners, with the binary logarithm of how many hold each.

    A hot token's postings are spread, so its rank is the estimate that all tasks share, and it counts as shared: if it
    were not, it would only go into a prefix that does without it.
    """
    owners, numbers, short, _ = blocks.gather(rows, WIDTH)
    order = np.lexsort((owners, short))
    owners, numbers, short = owners[order], numbers[order], short[order]
    rank = None
    if len(short):
        new = np.concatenate(([True], (short[1:] != short[:-1]) | (owners[1:] != owners[:-1])))
        owners, numbers, short = owners[new], numbers[new], short[new]
        cuts = np.flatnonzero(np.concatenate(([True], short[1:] != short[:-1])))
        df = np.diff(np.concatenate((cuts, [len(short)])))
        rank = np.repeat(np.ceil(np.log2(df)).astype(np.uint8), df)
        if len(hot):
            at = places(short, hot.short(WIDTH))
            rank[at >= 0] = hot_ranks(hot, sets)[at[at >= 0]]
        keep = rank > 0
        owners, numbers, short, rank = owners[keep], numbers[keep], short[keep], rank[keep]
        order = np.argsort(owners, kind="stable")
        owners, numbers, short, rank = owners[order], numbers[order], short[order], rank[order]
    yield from blocks.scatter(owners, numbers, short, blocks.target(owners, parts), WIDTH, rank)


def may_lack(n: int, percent: int) -> int:
    """How many of its ``n`` tokens a set can lack in a set that it links with."""
    return n - -(-n * percent // 100)


def band(n: int, percent: int) -> int:
    """The number of the size band: sizes of sets that link lie in the same band or neighbouring ones."""
    j, top, low = 0, 100, percent
    while n * low >= top:
        j, top, low = j + 1, top * 100, low * percent
    return j


def signatures(n: int, tokens: np.ndarray, ranks: np.ndarray, percent: int) -> np.ndarray:
    """The index entries of a set of ``n`` tokens, of which ``tokens`` stand in other sets too.

    ``ranks``: the binary logarithm of how many sets hold a token, rounded up. None if no set can link with it.
    """
    need = may_lack(n, percent) + 1 - (n - len(tokens))
    if need <= 0:
        return np.empty(0, np.uint64)
    order = np.lexsort((tokens, ranks))
    tokens, ranks = tokens[order], ranks[order]
    rare = int(np.searchsorted(ranks, FREQUENT, "right"))
    out = [mix(tokens[: min(rare, need)] + np.uint64(0x1234567))]
    need -= rare
    if need > 0:
        frequent = tokens[rare:]
        for joint in (band(n, percent), band(n, percent) + 1):
            smallest = -(-(100 ** max(joint - 1, 0)) // percent ** max(joint - 1, 0))
            groups = max(1, may_lack(smallest, percent) // 2)
            group = mix(frequent + np.uint64(joint)) % np.uint64(groups)
            first = np.zeros(len(frequent), bool)
            first[np.unique(group, return_index=True)[1]] = True
            cost = np.cumsum(~first)
            end = int(np.searchsorted(cost, need)) + 1
            used = np.argsort(group[:end], kind="stable")
            g, t = group[:end][used], frequent[:end][used]
            step = 1
            while step < len(g) and (same := g[step:] == g[:-step]).any():
                a, b = t[:-step][same], t[step:][same]
                low, high = np.minimum(a, b), np.maximum(a, b)
                out.append(mix(mix(low + np.uint64(joint)) + high))
                step += 1
    return np.unique(np.concatenate(out))


def _candidates(rows: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    owners, numbers, short, ranks = blocks.gather(rows, WIDTH)
    order = np.argsort(owners, kind="stable")
    if not len(owners):
        return
    cuts = np.flatnonzero(np.concatenate(([True], owners[order][1:] != owners[order][:-1])))
    out: list[list] = [[] for _ in range(6)]
    size = 0

    def batch() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["set_id", "n", "size", "sketch", "tokens", "entries"])

    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        own = order[a:b]
        n = int(numbers[own[0]])
        found = signatures(n, short[own], ranks[own], percent)
        if len(found):
            tokens = np.sort(short[own])
            for column, value in zip(out, (owners[own[0]].astype(np.int64), n, len(tokens), sketch(tokens), blocks._pack(tokens, WIDTH), found.view(np.int64)), strict=True):
                column.append(value)
            size += len(tokens) + len(found)
            if size > 1_000_000:
                yield batch()
                out, size = [[] for _ in range(6)], 0
    yield batch()


def _verify(rows: Iterator[pa.RecordBatch], exact: Callable) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        columns = [batch.column(c) for c in ("a_tokens", "b_tokens", "a_n", "b_n")]
        keep = [exact(*(x.as_py() for x in row)) for row in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["src", "dst"]).filter(pa.array(keep, pa.bool_()))


def jaccard_links(a: bytes, b: bytes, a_n: int, b_n: int, percent: int) -> bool:
    """Whether two sets link, given the packed tokens that they do not have alone."""
    x, y = (blocks._unpack(np.frombuffer(v, np.uint8), WIDTH) for v in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (a_n + b_n - both)


def sketch(tokens: np.ndarray, each: int = 4) -> bytes:
    """A bitmap of hashed tokens, at least ``each`` bits for each, a power of two in size."""
    bits = 64
    while bits < each * len(tokens):
        bits *= 2
    out = np.zeros(bits, bool)
    out[(mix(tokens + np.uint64(0xB175)) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """Rows of a bitmap, folded to ``words`` 64-bit words: a bit stands where any of its like stood."""
    while bitmap.shape[1] > words:
        half = bitmap.shape[1] // 2
        bitmap = bitmap[:, :half] | bitmap[:, half:]
    return bitmap


def jaccard_allows(percent: int, a_n, a_size, a_alone, b_n, b_size, b_alone):
    """Whether two sets can still link, given how many tokens at least each has alone."""
    both = np.minimum(a_size - a_alone, b_size - b_alone)
    return 100 * both >= percent * (a_n + b_n - both)


def _prune(rows: Iterator[pa.RecordBatch], allows: Callable) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        read = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
        alone: list[list[int]] = [[], []]
        for a, b in zip(batch.column("a_sketch"), batch.column("b_sketch"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), "<u8")[None, :] for v in (a, b))
            words = min(x.shape[1], y.shape[1])
            x, y = folded(x, words), folded(y, words)
            alone[0].append(int(np.bitwise_count(x & ~y).sum()))
            alone[1].append(int(np.bitwise_count(y & ~x).sum()))
        a_alone, b_alone = (np.array(v, np.int64) for v in alone)
        keep = allows(read("a_n"), read("a_size"), a_alone, read("b_n"), read("b_size"), b_alone)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _beside(columns: list[str], pairs: DataFrame, sets: DataFrame) -> DataFrame:
    side = lambda x: sets.select(F.col("set_id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in columns])
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *[f"{x}_{c}" for x in "ab" for c in columns])


#: Members of a group that one side of a cell holds, and the pairs compared at once.
CELL, AT_ONCE = 96, 1 << 16


def _between(x: dict[str, np.ndarray], y: dict[str, np.ndarray], same: bool, allows: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in x, in y) of all pairs between two lists of members, of one list if ``same``, that are apart and may link."""
    for x_bits in np.unique(x["bits"]):
        for y_bits in np.unique(y["bits"]):
            i, j = np.flatnonzero(x["bits"] == x_bits), np.flatnonzero(y["bits"] == y_bits)
            words = int(min(x_bits, y_bits))
            u = folded(np.stack([x["sketch"][k] for k in i]), words)
            v = folded(np.stack([y["sketch"][k] for k in j]), words)
            step = max(1, AT_ONCE // len(j))
            for at in range(0, len(i), step):
                rows = i[at : at + step]
                p, q = np.nonzero((x["component"][rows][:, None] != y["component"][j]) & ((x["set_id"][rows][:, None] < y["set_id"][j]) if same else True))
                if not len(p):
                    continue
                left, right = u[at : at + step][p], v[q]
                common = np.bitwise_count(left & right).sum(1, dtype=np.int64)
                a_alone = np.bitwise_count(left).sum(1, dtype=np.int64) - common
                b_alone = np.bitwise_count(right).sum(1, dtype=np.int64) - common
                a, b = rows[p], j[q]
                ok = allows(x["n"][a], x["size"][a], a_alone, y["n"][b], y["size"][b], b_alone)
                yield a[ok], b[ok]


class _Joined:
    """What the links found in a cell join."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.above.get(x, x)) != x:
            self.above[x] = x = self.above.get(up, up)
        return x

    def new(self, x: int, y: int, linked: Callable[[], bool]) -> bool:
        """Whether x and y are not joined yet and link."""
        if self.root(x) == self.root(y) or not linked():
            return False
        self.above[self.root(x)] = self.root(y)
        return True


def _cells(rows: Iterator[pa.RecordBatch], allows: Callable, exact: Callable) -> Iterator[pa.RecordBatch]:
    release()
    links: list[tuple[int, int]] = []
    batches = [b for b in rows if b.num_rows]
    if batches:
        table = pa.Table.from_batches(batches)
        read = {c: table.column(c).to_numpy() for c in ("grp", "i", "j", "block", "set_id", "component", "n", "size")}
        read["n"], read["size"] = read["n"].astype(np.int64), read["size"].astype(np.int64)
        order = np.lexsort((read["block"], read["j"], read["i"], read["grp"]))
        g, i, j = (read[c][order] for c in ("grp", "i", "j"))
        cuts = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
        sketches, tokens = (table.column(c).combine_chunks() for c in ("sketch", "tokens"))
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            own = order[a:b]
            side = {c: read[c][own] for c in ("set_id", "component", "n", "size", "block")} | {"at": own}
            side["sketch"] = np.empty(len(own), object)
            side["sketch"][:] = [np.frombuffer(sketches[int(k)].as_buffer(), "<u8") for k in own]
            side["bits"] = np.array([len(v) for v in side["sketch"]])
            first = side["block"] == i[a]
            x, y = ({c: v[first] for c, v in side.items()}, {c: v[~first] for c, v in side.items()}) if i[a] != j[a] else (side, side)
            joined = _Joined()
            for p, q in _between(x, y, x is y, allows):
                for s, t in zip(p.tolist(), q.tolist(), strict=True):
                    check = lambda: exact(tokens[int(x["at"][s])].as_py(), tokens[int(y["at"][t])].as_py(), int(x["n"][s]), int(y["n"][t]))  # noqa: B023, E731
                    if joined.new(int(x["component"][s]), int(y["component"][t]), check):
                        links.append((int(x["set_id"][s]), int(y["set_id"][t])))
    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["src", "dst"])


#: Members from which on splitting a unit is tried, and how often. It sends every token of a member through two shuffles,
#: which pays only where a member would go to about as many cells.
SPLIT, ROUNDS = 64 * CELL, 3


def _exploded(rows: Iterator[pa.RecordBatch], tokens_of: Callable[[bytes], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        units, sets = (batch.column(c).to_numpy() for c in ("unit", "set_id"))
        found = [tokens_of(t.as_py()) for t in batch.column("tokens")]
        counts = [len(f) for f in found]
        tokens = np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(units, counts)), pa.array(np.repeat(sets, counts)), pa.array(tokens)], ["unit", "set_id", "token"])


def _split(units: DataFrame, sets: DataFrame, tokens_of: Callable, need: str) -> DataFrame:
    """(unit, set_id, parent) of smaller units, so that any two members that link still have one in common.

    Within a unit tokens are ordered by how many of its members hold them. Two members that link share one of the
    ``need`` first tokens of either, so these name the new units; a token that one member alone holds names none. Work
    and rows grow with the members' tokens, not with the pairs of members.
    """
    wide = units.select("unit", "set_id").join(sets.select("set_id", "tokens"), "set_id")
    tokens = materialize(wide.mapInArrow(partial(_exploded, tokens_of=tokens_of), "unit long, set_id long, token long"), "unit-tokens")
    held = materialize(tokens.groupBy("unit", "token").agg(F.count("*").alias("df")), "unit-df")
    ordered = tokens.join(held, ["unit", "token"]).groupBy("unit", "set_id").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))  # a member's own tokens
    ordered = ordered.join(sets.select("set_id", F.expr(need).cast("int").alias("need")), "set_id").where("need > 0")
    first = ordered.select("unit", "set_id", F.explode(F.filter(F.slice("t", 1, F.col("need")), lambda x: x["df"] > 1)).alias("x"))
    return first.select(F.xxhash64("unit", "x.token").alias("unit"), "set_id", F.col("unit").alias("parent"))


#: Rows that a unit of m members sends to cells.
CELL_ROWS = f"m * ceil(m / {CELL})"


def _sized(units: DataFrame, known: DataFrame, *more: str) -> DataFrame:
    """Units whose members are in several components, with their number of members and of rows in cells."""
    sizes = units.join(known, "set_id").groupBy("unit", *more).agg(F.count("*").alias("m"), F.min("component").alias("low"), F.max("component").alias("high"))
    return sizes.where("low <> high").select("unit", *more, "m", F.expr(CELL_ROWS).alias("cost"))


def _units(entries: DataFrame, known: DataFrame) -> DataFrame:
    """(unit, set_id): what must be compared. Entries with the same least component make one unit, so that members are
    compared once, not once an entry, unless the entries by themselves send fewer rows to cells."""
    mixed = entries.groupBy("entry").agg(F.min("component").alias("grp"), F.max("component").alias("other"), F.count("*").alias("m")).where("grp <> other")
    mixed = materialize(mixed.select("entry", "grp", F.expr(CELL_ROWS).alias("cost")), "mixed")
    rows = materialize(entries.join(mixed.select("entry", "grp"), "entry").select("grp", "entry", "set_id"), "groups")
    together = rows.select("grp", "set_id").distinct().groupBy("grp").agg(F.count("*").alias("m"))
    whole = together.join(mixed.groupBy("grp").agg(F.sum("cost").alias("cost")), "grp").select("grp", (F.expr(CELL_ROWS) <= F.col("cost")).alias("whole"))
    unit = F.when(F.col("whole"), F.xxhash64("grp", F.lit("whole"))).otherwise(F.xxhash64("entry", F.lit("entry")))
    return materialize(rows.join(materialize(whole, "wholes"), "grp").select(unit.alias("unit"), "set_id").distinct(), "units")


def _fewer(entries: DataFrame, sets: DataFrame, tokens_of: Callable, need: str, splits: str) -> DataFrame:
    """(grp, set_id, component, blocks): units (:func:`_units`), those of many members split (:func:`_split`) where that at
    least halves the rows in cells."""
    known = materialize(entries.select("set_id", "component").distinct(), "known")
    units = _units(entries, known)
    ready, left = None, ROUNDS
    while True:
        sizes = _sized(units, known)
        odd = units.join(sets.where(f"not ({splits})").select("set_id"), "set_id", "left_semi").select("unit").distinct().withColumn("odd", F.lit(True))
        sizes = materialize(sizes.join(odd, "unit", "left") if splits != "true" else sizes.withColumn("odd", F.lit(None).cast("boolean")), "unit-sizes")
        large = sizes.where((F.col("m") > SPLIT) & F.col("odd").isNull()).select("unit", "cost")
        split = units.limit(0).select("unit")
        if left and not large.isEmpty():
            tried = materialize(_split(units.join(large.select("unit"), "unit", "left_semi"), sets, tokens_of, need).distinct(), "tried")
            after = _sized(tried, known, "parent").groupBy("parent").agg(F.sum("cost").alias("after")).withColumnRenamed("parent", "unit")
            split = materialize(large.join(after, "unit", "left").where("2 * coalesce(after, 0) <= cost").select("unit"), "split")
        done = units.join(sizes.join(split, "unit", "left_anti").select("unit", F.ceil(F.col("m") / CELL).cast("int").alias("blocks")), "unit")
        ready = done if ready is None else ready.unionByName(done)
        if split.isEmpty():
            return ready.join(known, "set_id").withColumnRenamed("unit", "grp").select("grp", "set_id", "component", "blocks")
        units, left = materialize(tried.join(split.withColumnRenamed("unit", "parent"), "parent", "left_semi").select("unit", "set_id"), "units"), left - 1


def _apart(entries: DataFrame, sets: DataFrame, allows: Callable, exact: Callable, tokens_of: Callable, need: str, splits: str) -> DataFrame:
    """Links between members with a common entry that are in different components yet, enough of them to join all that links join.

    Entries with the same least component make one group, so that its members are compared once, not once an entry.
    Where a group has more than ``SPLIT`` members, smaller ones are sought (:func:`_fewer`). A group is dealt into
    blocks by a hash, and each two blocks meet in one cell: sketches are compared as matrices, the pairs that they allow
    by their tokens, unless links of the cell join them already. Only links leave a cell.
    """
    spark = entries.sparkSession
    parts = partitions(spark)
    mixed = entries.groupBy("entry").agg(F.min("component").alias("grp"), F.max("component").alias("other")).where("grp <> other")
    rows = materialize(entries.join(materialize(mixed.select("entry", "grp"), "mixed"), "entry").select("grp", "set_id", "component").distinct(), "groups")
    sizes = materialize(rows.groupBy("grp").agg(F.count("*").alias("m"), F.ceil(F.count("*") / CELL).cast("int").alias("blocks")), "group-sizes")
    if sizes.where(F.col("m") > SPLIT).isEmpty():
        rows = rows.join(sizes.select("grp", "blocks"), "grp")
    else:
        rows = _fewer(entries, sets, tokens_of, need, splits)
    rows = rows.join(sets.select("set_id", "n", "size", "sketch", "tokens"), "set_id")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("set_id", F.lit(5)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")})
    rows = rows.withColumn("part", F.pmod(F.xxhash64("grp", "i", "j"), F.lit(parts)).cast("int"))
    rows = rows.select("grp", "i", "j", "block", "set_id", "component", "n", "size", "sketch", "tokens", "part").repartitionById(parts, "part")
    return materialize(rows.mapInArrow(partial(_cells, allows=allows, exact=exact), "src long, dst long"), "links")


def entry_links(entries: DataFrame, sets: DataFrame, fits: str, allows: Callable, exact: Callable, tokens_of: Callable, need: str, splits: str = "true") -> DataFrame:
    """(node, component) of all members with a link, where only members with a common entry can link.

    ``entries`` (set_id, n, lone, entry), ``sets`` (set_id, n, size, sketch, tokens); ``fits``: SQL over a_n and b_n
    that linked members meet; ``allows``: whether arrays of (n, size, tokens seen to be alone) of two members can link;
    ``exact``: whether two members' (tokens, tokens, n, n) do. ``tokens_of`` the tokens, two members that link share one of
    the ``need`` (SQL over n and size) first of either in any order common to both, if ``splits`` (SQL) holds of both.

    Of entries with the same members one is kept. Then each member is compared with one leader of its entries, members
    with the fewest ``lone`` tokens leading, and entries whose members are by now in one component are done. In the
    others every pair not in one component is compared, so no pair with a common entry goes without.
    """
    listed = entries.groupBy("entry").agg(F.count("*").alias("c"), F.sum(F.xxhash64("set_id").cast("decimal(38,0)")).alias("h")).where("c > 1")
    kept = materialize(listed.groupBy("c", "h").agg(F.min("entry").alias("entry")).select("entry"), "kept-entries")
    entries = materialize(entries.join(kept, "entry"), "entries")
    leads = materialize(entries.groupBy("entry").agg(F.min(F.struct("lone", "set_id", "n")).alias("lead")), "leads")
    led = entries.join(leads, "entry").where("set_id <> lead.set_id").select("set_id", F.col("n").alias("b_n"), F.col("lead.n").alias("a_n"), "lead").where(fits)
    pairs = led.groupBy("set_id").agg(F.min("lead").alias("lead")).select(F.col("lead.set_id").alias("a"), F.col("set_id").alias("b"))
    pairs = materialize(_beside(["n", "size", "sketch"], pairs, sets).mapInArrow(partial(_prune, allows=allows), "a long, b long"), "pairs")
    links = materialize(_beside(["n", "tokens"], pairs, sets).mapInArrow(partial(_verify, exact=exact), "src long, dst long"), "links")
    found = connected_components(links)
    known = entries.select("entry", "set_id", "n").join(found.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    more = _apart(known, sets, allows, exact, tokens_of, need, splits)
    return connected_components(found.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(more))


def near_duplicates(docs: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    Two documents link when 100 * intersection >= ``percent`` * union of their sets of distinct ``k``-word
    shingles, A-Z lower-cased; a text of fewer words has all its words as one. component_id is the smallest doc_id
    that links lead to, its own included. Texts that are null or without words have an empty set and no link. Rows
    that repeat are rows; a null doc_id is no smallest one unless alone. Other columns do not matter.
    """
    spark = docs.sparkSession
    parts = partitions_for(docs)
    members = materialize(docs.select("doc_id", "text").mapInArrow(partial(_members, k=k), "doc_id long, set_id long, n_shingles long"), "members")
    least = next(n for n in range(1, 10_000) if may_lack(n, percent) or may_lack(n + 1, percent))
    texts = docs.select("text")
    hot = find_in(texts, partial(shingles_of, k=k), distinct=True)
    sets = texts.count() if len(hot) else 0
    posted = blocks.exchange(texts.mapInArrow(partial(_postings, k=k, parts=parts, least=least, hot=hot), blocks.SCHEMA), parts)
    back = blocks.exchange(posted.mapInArrow(partial(_shared, parts=parts, hot=hot, sets=sets), blocks.SCHEMA), parts)
    sets = materialize(back.mapInArrow(partial(_candidates, percent=percent), "set_id long, n int, size int, sketch binary, tokens binary, entries array<long>"), "sets")
    entries = sets.select("set_id", "n", (F.col("n") - F.col("size")).alias("lone"), F.explode("entries").alias("entry"))
    fits = f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)"
    need = f"n - (n * {percent} + 99) div 100 + 1 - (n - size)"
    found = materialize(entry_links(entries, sets, fits, partial(jaccard_allows, percent), partial(jaccard_links, percent=percent), unpacked, need), "found")
    classes = members.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("low"), F.count("*").alias("c"))
    classes = materialize(classes.join(found.withColumnRenamed("node", "set_id"), "set_id", "left").where("c > 1 or component is not null"), "classes")
    lows = materialize(classes.where("component is not null").groupBy("component").agg(F.min("low").alias("least")), "component-lows")
    named = materialize(classes.join(lows, "component", "left").select("set_id", F.coalesce("least", "low").alias("component_id")), "named")
    drop_written(sets)
    out = members.join(named, "set_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
