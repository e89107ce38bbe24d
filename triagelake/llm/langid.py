"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy.

A text's bytes, A-Z lower-cased, are cut at ASCII bytes that are not letters, and every 32 bytes of a longer run;
both recurrences start anew at each segment. The network gives every position a probability for each label, and
a document's probabilities are the mean over all positions of its whole text. As a segment's probabilities depend
on its bytes alone, a worker computes each distinct segment once, as long as its bounded memo holds it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name
from .tokenize import batches
from .worker import held

SEGMENT = 32
UNKNOWN = "und"
#: Segments a worker's memo holds before it starts anew.
MEMO_SEGMENTS = 200_000
CUT = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
ASCII_LETTER = re.compile(rb"[A-Za-z]")


def segments(data: bytes) -> list[bytes]:
    """The segments of a text's bytes, in order."""
    words = data.translate(CUT).split()
    if max(map(len, words), default=0) <= SEGMENT:
        return words
    return [w[i : i + SEGMENT] for w in words for i in range(0, len(w), SEGMENT)]


def has_letter(text: str | None, data: bytes) -> bool:
    """Whether a text holds a letter of any script."""
    return bool(text) and (ASCII_LETTER.search(data) is not None or any(map(str.isalpha, text)))


@dataclass
class Direction:
    """One recurrence: byte table with biases (256 x 3H) and state weights (H x 3H); gates z, r, n side by side."""

    table: np.ndarray
    state: np.ndarray

    def run(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States after each of the T steps of ``x`` (batch x T), and what going back needs."""
        size, steps = x.shape
        width = self.state.shape[0]
        h = np.zeros((size, width), self.table.dtype)
        out = np.empty((steps, size, width), self.table.dtype)
        trail = []
        for t in range(steps):
            seen, own = self.table[x[:, t]], h @ self.state
            zr = 1 / (1 + np.exp(-(seen[:, : 2 * width] + own[:, : 2 * width])))
            z, r = zr[:, :width], zr[:, width:]
            n = np.tanh(seen[:, 2 * width :] + r * own[:, 2 * width :])
            if keep:
                trail.append((h, z, r, n, own[:, 2 * width :]))
            h = n + z * (h - n)
            out[t] = h
        return out, trail

    def back(self, x: np.ndarray, trail: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of table and state weights from those of all states (T x batch x H)."""
        size, steps = x.shape
        d_table, d_state = np.zeros_like(self.table), np.zeros_like(self.state)
        dh = np.zeros_like(grad[0])
        rows = np.arange(size)
        for t in reversed(range(steps)):
            h, z, r, n, own = trail[t]
            dh = dh + grad[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * own * r * (1 - r)
            d_own = np.concatenate([dz, dr, dn * r], 1)
            one_hot = np.zeros((256, size), self.table.dtype)
            one_hot[x[:, t], rows] = 1
            d_table += one_hot @ np.concatenate([dz, dr, dn], 1)
            d_state += h.T @ d_own
            dh = dh * z + d_own @ self.state.T
        return d_table, d_state


@dataclass
class Network:
    """Both recurrences and the output layer over their joined states."""

    labels: list[str]
    ahead: Direction
    behind: Direction
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, labels: list[str], width: int, seed: int, dtype: type = np.float32) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(dtype)
        directions = [Direction(draw(256, 3 * width), draw(width, 3 * width)) for _ in range(2)]
        return cls(labels, *directions, draw(2 * width, len(labels)), np.zeros(len(labels), dtype))

    def weights(self) -> list[np.ndarray]:
        return [self.ahead.table, self.ahead.state, self.behind.table, self.behind.state, self.out, self.bias]

    def _positions(self, x: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray, list, list]:
        a, trail_a = self.ahead.run(x, keep)
        b, trail_b = self.behind.run(x[:, ::-1], keep)
        both = np.concatenate([a, b[::-1]], 2)
        logits = both @ self.out + self.bias
        p = np.exp(logits - logits.max(2, keepdims=True))
        return p / p.sum(2, keepdims=True), both, trail_a, trail_b

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """T x batch x labels for segments of one length (batch x T bytes)."""
        return self._positions(x, False)[0]

    def loss_and_gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions, each with its segment's label, and backpropagation through time."""
        p, both, trail_a, trail_b = self._positions(x, True)
        steps, size, _ = p.shape
        rows = np.arange(size)
        loss = -float(np.log(p[:, rows, y] + 1e-12).mean())
        d = p.copy()
        d[:, rows, y] -= 1
        d /= steps * size
        d_both = d @ self.out.T
        width = d_both.shape[2] // 2
        grads = [*self.ahead.back(x, trail_a, d_both[:, :, :width]), *self.behind.back(x[:, ::-1], trail_b, d_both[::-1, :, width:])]
        grads += [np.einsum("tbh,tbl->hl", both, d), d.sum((0, 1))]
        return loss, grads


def train(texts: list[tuple[str, list[bytes]]], width: int = 16, steps: int = 500, batch: int = 256, seed: int = 7) -> Network | None:
    """A network fitted by Adam to (label, segments) pairs; labels weigh alike. None without any segment.

    A batch holds segments of one length, drawn in proportion to the positions they hold.
    """
    labels = sorted({label for label, some in texts if some})
    if not labels:
        return None
    number = {label: i for i, label in enumerate(labels)}
    pools: dict[int, tuple[list[bytes], list[int]]] = defaultdict(lambda: ([], []))
    for label, some in texts:
        for s in some:
            pools[len(s)][0].append(s)
            pools[len(s)][1].append(number[label])
    lengths = sorted(pools)
    x = {n: np.frombuffer(b"".join(pools[n][0]), np.uint8).reshape(-1, n) for n in lengths}
    y = {n: np.array(pools[n][1]) for n in lengths}
    count = np.zeros(len(labels))
    for n in lengths:
        count += np.bincount(y[n], minlength=len(labels)) * n
    chance = {n: (1 / np.maximum(count, 1))[y[n]] for n in lengths}
    share = np.array([chance[n].sum() * n for n in lengths])
    net, rng = Network.new(labels, width, seed), np.random.default_rng(seed)
    m, v = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()]
    cumulative = {n: np.cumsum(chance[n]) / chance[n].sum() for n in lengths}
    for step in range(1, steps + 1):
        n = lengths[rng.choice(len(lengths), p=share / share.sum())]
        pick = np.minimum(np.searchsorted(cumulative[n], rng.random(batch)), len(y[n]) - 1)
        _, grads = net.loss_and_gradients(x[n][pick], y[n][pick])
        rate = 0.02 * (1 - step / (steps + 1))
        for w, g, m_i, v_i in zip(net.weights(), grads, m, v, strict=True):
            m_i += 0.1 * (g - m_i)
            v_i += 0.01 * (g * g - v_i)
            w -= rate * (m_i / (1 - 0.9**step)) / (np.sqrt(v_i / (1 - 0.99**step)) + 1e-8)
    return net


class Labeller:
    """Sums of position probabilities by segment, with a bounded memo."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self.memo: dict[bytes, int] = {}
        self.sums = np.zeros((1024, len(net.labels)), np.float32)

    def _learn(self, new: list[bytes]) -> None:
        first = len(self.memo)
        new.sort(key=len)
        self.memo.update(zip(new, range(first, first + len(new)), strict=True))
        while first + len(new) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        at = 0
        while at < len(new):
            n = len(new[at])
            end = at
            while end < len(new) and len(new[end]) == n and end - at < 4096:
                end += 1
            x = np.frombuffer(b"".join(new[at:end]), np.uint8).reshape(-1, n)
            self.sums[first + at : first + end] = self.net.probabilities(x).sum(0)
            at = end

    def documents(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(label, mean probability) of each text; ``und`` and 0 without a letter."""
        if len(self.memo) > MEMO_SEGMENTS:
            self.memo.clear()
        data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        split = [segments(d) for d in data]
        self._learn([s for s in set().union(*split) if s not in self.memo])
        out = []
        for text, d, some in zip(texts, data, split, strict=True):
            if not some or not has_letter(text, d):
                out.append((UNKNOWN, 0.0))
                continue
            rows = np.fromiter(map(self.memo.__getitem__, some), np.int64, len(some))
            total = self.sums[rows].sum(0, dtype=np.float64)
            best = int(total.argmax())
            out.append((self.net.labels[best], float(min(1.0, total[best] / total.sum()))))
        return out


def held_out(doc_id: Column) -> Column:
    """Whether a document takes no part in training; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _some_segments(rows: Iterator[pa.RecordBatch], per_document: int) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        out = []
        for text in batch.column(2).to_pylist():
            found = segments(text.encode("utf-8", "surrogatepass"))
            if len(found) > per_document:
                found = [found[i * len(found) // per_document] for i in range(per_document)]
            out.append(b" ".join(found))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "lang", "segments"])


def fit(docs: DataFrame, per_label: int = 400, per_document: int = 64, steps: int = 500) -> Network | None:
    """Train on a bounded sample: of each label about ``per_label`` documents that are not held out, chosen by a hash of
    their id, and of each ``per_document`` segments spread evenly over its whole text. Every label is learnt.

    Texts and labels alone reach the network. None if no document has both.
    """
    known = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # the network's labels
    if not counts:
        return None
    # Of 2**62 hashes, so that a share is met however many documents a label has.
    least = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, (1 << 62) * per_label // max(per_label, n))])
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 62)) < F.element_at(least, F.col("lang")))
    rows = drawn.select("doc_id", "lang", "text").mapInArrow(partial(_some_segments, per_document=per_document), "doc_id long, lang string, segments binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.lang, bytes(r.segments)))
    return train([(r.lang, bytes(r.segments).split()) for r in rows], steps=steps)


def _identify(rows: Iterator[pa.RecordBatch], net: Network | None, keep: list[str], key: int) -> Iterator[pa.RecordBatch]:
    labeller = held(("labeller", key), lambda: Labeller(net)) if net is not None else None
    for batch in rows:
        texts = batch.column(len(keep)).to_pylist()
        found: list[tuple[str, float]] = []
        for some in batches(texts, 2_000_000):
            found += labeller.documents(texts[some]) if labeller else [(UNKNOWN, 0.0)] * len(texts[some])
        columns = [batch.column(c) for c in keep] + [pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, [*keep, "lang_pred", "score"])


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """``docs`` with lang_pred and score of every whole ``text``; columns of those names are replaced.

    ``und`` and 0 where the text is null, empty or without a letter, and everywhere if there is no network.
    Repeated rows give repeated results; an empty table gives none. Other columns pass through, unread.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = T.StructType([*[f for f in docs.schema.fields if f.name in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    key = hash(b"".join(w.tobytes() for w in net.weights())) if net else 0
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias(free_name(docs, "text_to_judge"))).mapInArrow(partial(_identify, net=net, keep=keep, key=key), schema)
