"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model file is compiled into machines: a normaliser (spaces to the piece mark, a mark put first), the pieces (a trie
whose final states give ids, with a byte fallback arc for characters that no piece holds), and an acceptor of neighbouring
pieces. Composed with an input they give a lattice of segmentations, and the encoding is its shortest path in the
tropical semiring: weights along a path add, of paths the least counts. Composition is lazy: only states that the search
reaches are made.

For a unigram model a piece's arc weighs minus its score and any piece may follow any other. For a byte-pair model sums
of scores are not what decides; there arcs weigh 0 and the acceptor lets piece b follow piece a at weight 0 only if
merging their joined text gives just a and b, and at infinite weight else. A segmentation whose neighbours all pass is
the one that merging finds, and there is exactly one, so the shortest path is the merged result.

Where two characters never stand side by side in a piece, every path closes a piece between them and no merge crosses.
So an input falls into chunks, spaces with the letters behind them or a run of marks, after each of which the normaliser
is in one state and the pieces in their start. A bounded memo keeps the chunks' paths.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokenize import batches
from .worker import held

MARK = "▁"
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
MEMO_WORDS = 600_000
INFINITE = float("inf")
SCHEMA = "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_sha256 string"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Normaliser:
    """A transducer over runs of spaces and of other characters: arcs (state, is space) -> (next state, output).

    ``None`` as output copies the run. ``squeeze``: a run of spaces counts as one, those at either end as none.
    """

    START, BODY, GAP = range(3)

    def __init__(self, prefix: bool, squeeze: bool) -> None:
        first = MARK if prefix else ""
        if squeeze:
            self.arcs = {(self.START, True): (self.START, ""), (self.BODY, True): (self.GAP, ""), (self.GAP, True): (self.GAP, "")}
            self.arcs |= {(self.START, False): (self.BODY, first), (self.BODY, False): (self.BODY, ""), (self.GAP, False): (self.BODY, MARK)}
        else:
            self.arcs = {(self.START, space): (self.BODY, first) for space in (True, False)} | {(self.BODY, space): (self.BODY, "") for space in (True, False)}
        self.squeeze = squeeze

    def run(self, state: int, text: str) -> tuple[int, str]:
        """(state after, output) of a text from ``state``."""
        out = []
        for part in re.findall(" +|[^ ]+", text):
            space = part[0] == " "
            state, before = self.arcs[state, space]
            out.append(before)
            if not space:
                out.append(part)
            elif not self.squeeze:
                out.append(MARK * len(part))
        return state, "".join(out)


class Pieces:
    """The trie of pieces as a transducer: ``arcs[state][char]`` is the next state, ``final[state]`` the (weight, piece)
    that closes there and leads back to state 0. ``fallback`` weighs the arc of a character that is no piece."""

    def __init__(self, weights: dict[str, float], fallback: float) -> None:
        none: dict[str, int] = {}
        self.arcs: list[dict[str, int]] = [{}]
        self.final: list[tuple[float, str] | None] = [None]
        for piece, weight in weights.items():
            state = 0
            for char in piece:
                if self.arcs[state] is none:
                    self.arcs[state] = {}
                state, before = self.arcs[state].setdefault(char, len(self.arcs)), state
                if state == len(self.arcs):
                    self.arcs.append(none)
                    self.final.append(None)
            self.final[state] = (weight, piece)
        self.fallback = fallback
        self.flat = not fallback and not any(weights.values())


class AnyNeighbours:
    """The acceptor of a unigram model: one state, every piece passes at weight 0."""

    def state(self, piece: str) -> str:
        return ""

    def weight(self, state: str, piece: str) -> float:
        return 0.0


class MergedNeighbours:
    """The acceptor of a byte-pair model: its state is the last piece, and a piece passes if merging leaves both as they are.

    After a character without a piece, as at the start, the state is empty and a piece passes if merging makes it. If all
    neighbours pass, no merge of the whole text crosses a border: the first to do so would also do in merging those two.
    """

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        self.known: dict[tuple[str, str], float] = {}

    def merge(self, text: str) -> list[str]:
        """Byte-pair merging: the adjacent pair with the best joined piece, the leftmost of equals, until none is left."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, where = None, 0
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, where = score, i
            if best is None:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def state(self, piece: str) -> str:
        return piece

    def weight(self, state: str, piece: str) -> float:
        found = self.known.get((state, piece))
        if found is None:
            if len(self.known) > 2 * MEMO_WORDS:
                self.known.clear()
            found = self.known[state, piece] = 0.0 if self.merge(state + piece) == ([state, piece] if state else [piece]) else INFINITE
        return found


def shortest_path(text: str, pieces: Pieces, neighbours: AnyNeighbours | MergedNeighbours) -> list[str]:
    """The pieces along the lightest path of a text through both machines; a character that no piece holds stands alone.

    Best first over states (place in the text, state of the acceptor), which needs weights of 0 or more: of equal weights
    the path that has come farthest goes first, then the one whose last piece is longest. An arc's weight by the acceptor
    is looked up only when its turn comes. Where all pieces weigh 0, what is queued last has come farthest, so the queue
    is a stack.
    """
    n, arcs, final, weight_of, state_of = len(text), pieces.arcs, pieces.final, neighbours.weight, neighbours.state
    root = arcs[0]
    queue: list[tuple[float, int, int, str, str]] = []
    push, pop = (list.append, list.pop) if pieces.flat else (heapq.heappush, heapq.heappop)
    back: dict[tuple[int, str], tuple[int, str, str]] = {}
    at, place, state = 0.0, 0, ""
    while place < n:
        node = root.get(text[place], 0)
        if not node or final[node] is None:
            push(queue, (at + pieces.fallback, -place - 1, place, state, ""))
        end = place
        while node:
            end += 1
            closed = final[node]
            if closed is not None:
                push(queue, (at + closed[0], -end, place, state, closed[1]))
            node = arcs[node].get(text[end], 0) if end < n else 0
        while True:
            at, end, start, before, piece = pop(queue)
            if piece and (step := weight_of(before, piece)):
                if step != INFINITE:
                    push(queue, (at + step, end, start, before, piece))
                continue
            place, state = -end, state_of(piece)
            if (place, state) not in back:
                back[place, state] = start, before, piece
                break
    out: list[str] = []
    while place:
        start, before, piece = back[place, state]
        out.append(piece or text[start])
        place, state = start, before
    out.reverse()
    return out


class Memo(dict):
    """chunk -> the ids along its path, learnt at the first look-up; of full memos the last one stays at hand."""

    def __init__(self, machine: Model, state: int) -> None:
        super().__init__()
        self.machine, self.state, self.old = machine, state, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.machine.ids_of(self.machine.normaliser.run(self.state, chunk)[1])
        self[chunk] = ids
        return ids

    def shrink(self, most: int) -> None:
        """Start anew if ``most`` chunks are held."""
        if len(self) > most:
            self.old = dict(self)
            self.clear()


def chunk_pattern(pieces: Iterable[str]) -> re.Pattern:
    """What an input is cut into: spaces and marks with a run of characters of one kind behind them, or alone.

    Characters are of one kind if a chain of neighbours in pieces joins them; one without neighbours stands alone.
    """
    above: dict[str, str] = {}

    def root(c: str) -> str:
        while (up := above.setdefault(c, c)) != c:
            above[c] = c = above.setdefault(up, up)
        return c

    for piece in pieces:
        chars = piece.lstrip(MARK)
        for x, y in zip(chars, chars[1:], strict=False):
            above[root(x)] = root(y)
    kinds: dict[str, list[str]] = {}
    for c in list(above):
        kinds.setdefault(root(c), []).append(c)
    runs = [f"[{''.join(map(re.escape, sorted(k)))}]+" for k in sorted(kinds.values(), key=len, reverse=True)]
    return re.compile(f"[ {MARK}]*(?:{'|'.join([*runs, f'[^ {MARK}]'])})|[ {MARK}]+")


class Model:
    """A compiled model; ``encode`` and ``decode`` are each other's inverse up to the normaliser."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            parts = list(_fields(f.read()))
        trainer = dict(_fields(next(v for k, v in parts if k == 2)))
        normaliser = dict(_fields(next((v for k, v in parts if k == 3), b"")))
        if normaliser.get(2):
            raise ValueError("models with a character map of their own are not supported")
        if not normaliser.get(5, 1):
            raise ValueError("models that leave spaces as they are are not supported")
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and byte-pair models have weights")
        self.prefix, self.squeeze = bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1))
        scores: dict[str, float] = {}
        self.id_of: dict[str, int] = {}
        self.text_of: list[bytes] = []
        self.byte_ids: dict[int, int] = {}
        self.unknown = 0
        for number, (_, value) in enumerate(x for x in parts if x[0] == 1):
            piece = dict(_fields(value))
            text, kind = piece[1].decode(), piece.get(3, NORMAL)
            if kind == USER:
                raise ValueError("models with user-defined pieces are not supported")
            shown = b""
            if kind == NORMAL:
                self.id_of[text], scores[text] = number, struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0]
                shown = text.replace(MARK, " ").encode()
            elif kind == BYTE:
                self.byte_ids[int(text[3:5], 16)] = number
                shown = bytes([int(text[3:5], 16)])
            elif kind == UNKNOWN:
                self.unknown, shown = number, " ⁇ ".encode()
            self.text_of.append(shown)
        #: ids of pieces that begin with the mark
        self.marked = {number for text, number in self.id_of.items() if text.startswith(MARK)}
        self.normaliser = Normaliser(self.prefix, self.squeeze)
        if self.kind == BPE:
            self.pieces, self.neighbours = Pieces(dict.fromkeys(scores, 0.0), 0.0), MergedNeighbours(scores)
        else:
            # Every path holds each character once, so a constant for each makes weights 0 or more and changes no order.
            each = max(0.0, *scores.values()) if scores else 0.0
            worst = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
            self.pieces, self.neighbours = Pieces({p: each * len(p) - s for p, s in scores.items()}, each - worst), AnyNeighbours()
        whole = any(MARK in p.lstrip(MARK) for p in scores)  # a piece goes on behind a mark: no cut is safe
        self.chunks = re.compile("(?s).+") if whole else chunk_pattern(scores)
        self.first, self.memo = Memo(self, Normaliser.START), Memo(self, Normaliser.BODY)

    def ids_of(self, normal: str) -> bytes:
        """Ids along the shortest path of a normalised chunk, as little-endian unsigned 32-bit bytes."""
        out: list[int] = []
        for piece in shortest_path(normal, self.pieces, self.neighbours):
            number = self.id_of.get(piece)
            out += self.fallback(piece) if number is None else (number,)
        return array("I", out).tobytes()

    def fallback(self, char: str) -> list[int]:
        """Ids of a character that no piece holds."""
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit bytes; null and empty texts have none."""
        if self.squeeze:
            text = (text or "").strip(" ").rstrip(f" {MARK}")
        if not text:
            return b""
        chunks = self.chunks.findall(text)
        self.memo.shrink(MEMO_WORDS)
        self.first.shrink(MEMO_WORDS // 8)
        ids = self.first[chunks[0]] + b"".join(map(self.memo.__getitem__, chunks[1:]))
        return ids if self.byte_ids else self._one_unknown(ids)

    def _one_unknown(self, ids: bytes) -> bytes:
        """Without byte pieces a run of unknown characters has one id."""
        found = np.frombuffer(ids, "<u4")
        again = np.concatenate(([False], (found[1:] == self.unknown) & (found[:-1] == self.unknown)))
        return found[~again].tobytes()

    def decode(self, ids: bytes) -> str:
        """The text of ids: bytes that are no UTF-8 become U+FFFD, and the space put first goes."""
        numbers = array("I", ids)
        shown = list(map(self.text_of.__getitem__, numbers))
        if self.prefix or self.squeeze:
            for i, number in enumerate(numbers):
                if number in self.marked:
                    shown[i] = shown[i][1:]
                if shown[i] or not self.squeeze:  # squeezed, a mark alone does not end the beginning
                    break
        return b"".join(shown).decode("utf-8", "replace")


def model(path: str) -> Model:
    """The worker's own compiled model; its memo outlives the task."""
    return held(("pieces", path), lambda: Model(path))


def _round_trip(rows: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    machine = model(path)
    of_byte = np.zeros(len(machine.text_of), bool)
    of_byte[list(machine.byte_ids.values())] = True
    for batch in rows:
        doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for some in batches(texts):
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(doc_ids[some], texts[some], strict=True):
                ids = machine.encode(text)
                of_bytes = int(of_byte[np.frombuffer(ids, "<u4")].sum())
                decoded = machine.decode(ids).encode("utf-8", "surrogatepass")
                for column, value in zip(out, (doc_id, len(ids) // 4, of_bytes, zlib.crc32(ids), hashlib.sha256(decoded).hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.string())], ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "decoded_sha256"])


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_crc32 (of little-endian unsigned 32-bit ids) and decoded_sha256 of every
    whole text of ``docs``.

    Null and empty texts have no pieces and decode to the empty text. Repeated rows give repeated results, null
    doc_ids stay null, other columns do not matter, an empty table gives no rows.
    """
    return docs.select("doc_id", "text").mapInArrow(partial(_round_trip, path=path), SCHEMA)


def _encode(rows: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    machine = model(path)
    for batch in rows:
        ids = [array("I", machine.encode(t)).tolist() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of every whole text as an array."""
    return docs.select("doc_id", "text").mapInArrow(partial(_encode, path=path), "doc_id long, ids array<long>")


def _decode(rows: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    machine = model(path)
    for batch in rows:
        texts = [machine.decode(array("I", ids or []).tobytes()) for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of (doc_id, ids); null ids count as none."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decode, path=path), "doc_id long, text string")
