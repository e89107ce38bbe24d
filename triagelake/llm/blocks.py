"""Packed exchanges: postings of tokens and owners, shuffled as a few binary blocks instead of a row each.

A map task collects postings, cuts them by target partition and sends one block per target and batch. A block holds
records, one per owner: the owner's 64-bit id, a 32-bit number of its own, and its tokens, of which only the first
``width`` bytes travel. The target of a posting follows from the upper 32 bits of its token or owner alone, so blocks
of equal keys meet, and as tokens are hashes the targets are even; tokens with too many postings for that (``hot``) are
dealt by token and owner.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import mix
from .worker import release

SCHEMA = "part int, data binary"
ARROW = pa.schema([("part", pa.int32()), ("data", pa.binary())])
#: Postings that a map task holds before it sends them off.
HELD = 1_000_000


def target(keys: np.ndarray, parts: int) -> np.ndarray:
    """The partition of each 64-bit key."""
    return (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int32)


class Hot:
    """Hot tokens, sorted, each with the share of all sampled units that hold it."""

    def __init__(self, tokens: np.ndarray, shares: np.ndarray) -> None:
        order = np.argsort(tokens)
        self.tokens, self.shares = tokens[order], shares[order]

    def __len__(self) -> int:
        return len(self.tokens)

    def short(self, width: int) -> np.ndarray:
        """The upper ``width`` bytes of each token."""
        return self.tokens >> np.uint64(64 - 8 * width)


NONE = Hot(np.empty(0, np.uint64), np.empty(0, np.float64))


def places(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where each value stands in sorted ``known``; -1 where it does not."""
    if not len(known):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def dealt(tokens: np.ndarray, owners: np.ndarray, hot: Hot, parts: int) -> np.ndarray:
    """The partition of each posting: by its token, or of hot ones by token and owner."""
    to = target(tokens, parts)
    if len(hot):
        salted = places(tokens, hot.tokens) >= 0
        to[salted] = target(mix(tokens[salted] ^ mix(owners[salted])), parts)
    return to


def shorten(tokens: np.ndarray, width: int) -> np.ndarray:
    """The upper ``width`` bytes of 64-bit tokens, as 64-bit numbers."""
    return tokens >> np.uint64(64 - 8 * width)


def _pack(short: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(short.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(data: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = data.reshape(-1, width)
    return out.view("<u8").ravel()


def encode(owners: np.ndarray, numbers: np.ndarray, counts: np.ndarray, short: np.ndarray, width: int, extra: np.ndarray | None = None) -> bytes:
    """One block: records of (owner, number, its tokens); ``extra``: a byte for each token."""
    head = np.array([len(owners), 0 if extra is None else 1], "<u4").tobytes()
    rest = b"" if extra is None else extra.astype(np.uint8).tobytes()
    return b"".join((head, owners.astype("<u8").tobytes(), numbers.astype("<u4").tobytes(), counts.astype("<u4").tobytes(), _pack(short, width), rest))


def decode(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """owners, numbers, counts, short tokens, extra of a block."""
    n, has = np.frombuffer(data, "<u4", 2)
    n = int(n)
    owners = np.frombuffer(data, "<u8", n, 8)
    numbers = np.frombuffer(data, "<u4", n, 8 + 8 * n)
    counts = np.frombuffer(data, "<u4", n, 8 + 12 * n)
    total, at = int(counts.sum()), 8 + 16 * n
    short = _unpack(np.frombuffer(data, np.uint8, total * width, at), width)
    extra = np.frombuffer(data, np.uint8, total, at + total * width) if has else None
    return owners, numbers, counts, short, extra


def gather(rows: Iterator[pa.RecordBatch], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """All postings of a partition: owner, number, short token, extra, one entry each."""
    release()
    got: list[tuple] = []
    for batch in rows:
        for data in batch.column("data"):
            owners, numbers, counts, short, extra = decode(data.as_buffer().to_pybytes(), width)
            got.append((np.repeat(owners, counts), np.repeat(numbers, counts), short, extra))
    if not got:
        return np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.uint64), None
    owners, numbers, short, extra = zip(*got, strict=True)
    return np.concatenate(owners), np.concatenate(numbers), np.concatenate(short), None if extra[0] is None else np.concatenate(extra)


def batch_of(parts: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(data, pa.binary())], schema=ARROW)


def scatter(owners: np.ndarray, numbers: np.ndarray, short: np.ndarray, to: np.ndarray, width: int, extra: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Blocks of postings by target ``to``; postings of an owner must stand together."""
    if not len(to):
        return
    order = np.argsort(to.astype(np.uint16) if int(to.max()) < 1 << 16 else to, kind="stable")
    to, owners, numbers, short = to[order], owners[order], numbers[order], short[order]
    extra = extra[order] if extra is not None else None
    cuts = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
    for a, b in zip(cuts, [*cuts[1:], len(to)], strict=True):
        own = owners[a:b]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        counts = np.diff(np.concatenate((first, [b - a])))
        yield batch_of([int(to[a])], [encode(own[first], numbers[a:b][first], counts, short[a:b], width, None if extra is None else extra[a:b])])


class Outbox:
    """Collects (owner, number, 64-bit tokens) and yields blocks by token whenever enough are held."""

    def __init__(self, parts: int, width: int, hot: Hot = NONE) -> None:
        release()
        self.parts, self.width, self.hot = parts, width, hot
        self.held: list[tuple[int, int, np.ndarray]] = []
        self.size = 0

    def add(self, owner: int, number: int, tokens: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(tokens):
            self.held.append((owner, number, tokens))
            self.size += len(tokens)
        if self.size >= HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            counts = [len(t) for _, _, t in self.held]
            owners = np.repeat(np.array([o for o, _, _ in self.held], np.uint64), counts)
            numbers = np.repeat(np.array([n for _, n, _ in self.held], np.uint32), counts)
            tokens = np.concatenate([t for _, _, t in self.held])
            self.held, self.size = [], 0
            yield from scatter(owners, numbers, shorten(tokens, self.width), dealt(tokens, owners, self.hot, self.parts), self.width)


def exchange(blocks: DataFrame, parts: int) -> DataFrame:
    """Blocks to their partitions."""
    return blocks.repartitionById(parts, "part")
