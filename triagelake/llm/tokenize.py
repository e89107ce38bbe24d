"""Encoding with the tokenizers library, each distinct word once per worker.

A word-level vocabulary file never lets a token cross ASCII white space: its pre-tokenizer drops
white space and matches no token over it, and no normaliser step looks across it. So a text's ids
are the ids of its words, one after another, and a bounded memo of words replaces most of the work.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterable

from .worker import held

#: Words the memo holds per worker before it starts anew, the last full one staying at hand.
MEMO_WORDS = 150_000
#: ASCII marks that the pre-tokenizer cuts off a word's end as one run.
MARKS = b".,!*&%$#;:?"
MARK_CHARS = MARKS.decode()


def _byte_letters() -> dict[int, int]:
    """The usual byte-level alphabet: printable Latin-1 bytes stand for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(plain))
    return {b: 256 + i for i, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


class Memo(dict):
    """word -> ids, learnt at the first look-up."""

    def __init__(self, tokenizer, cut_marks: bool) -> None:
        super().__init__()
        self.tokenizer, self.cut_marks = tokenizer, cut_marks
        self.old: dict[bytes, bytes] = {}

    def shrink(self, most: int) -> None:
        """Start anew if ``most`` words are held."""
        if len(self) > most:
            self.old = dict(self)
            self.clear()

    def whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def letters(self, stem: bytes) -> bytes:
        """Ids of lower-case letters: one pre-token."""
        mapped = stem.decode("ascii") if stem.isascii() else stem.decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        known = self.old.get(word)
        if known is not None:
            self[word] = known
            return known
        if self.cut_marks:
            if word.isascii():
                low = word.lower()
                stem = low.rstrip(MARKS)
                simple = stem.isalpha()
            else:
                stem = low = word
                text = word.decode("utf-8", "surrogatepass").lower()
                letters = text.rstrip(MARK_CHARS)
                # Up to U+024F one letter lower-cases to one, and composed letters are the normal form.
                simple = letters.isalpha() and max(letters) < "\u0250"
                if simple:
                    low, stem = text.encode(), letters.encode()
            if simple:
                ids = self.get(stem)
                if ids is None:
                    ids = self[stem] = self.old.get(stem) or self.letters(stem)
                if len(stem) < len(low):
                    ids += self[low[len(stem) :]]
                    self[word] = ids
                elif word != stem:
                    self[word] = ids
                return ids
        ids = self[word] = self.whole(word.decode("utf-8", "surrogatepass"))
        return ids


class WordEncoder:
    """``encode_many(texts)`` gives the ids of whole texts as little-endian unsigned 32-bit bytes.

    ``by_words`` False encodes whole texts, for vocabularies whose tokens may hold white space.
    """

    def __init__(self, path: str, by_words: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = by_words
        trial = Memo(self.tokenizer, True)
        probe = ["Abacus", "qzxv.", "the?!;", "a", "Éclair,", "straße", "ñandú.", "ångström", "Ÿ"]
        #: whether the vocabulary lower-cases words, cuts closing marks off them and maps bytes to letters
        self.cut_marks = by_words and all(trial[w.encode()] == trial.whole(w) for w in probe)
        self.memo = Memo(self.tokenizer, self.cut_marks)

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        if not self.by_words:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        self.memo.shrink(MEMO_WORDS)
        get = self.memo.__getitem__
        return [b"".join(map(get, (t or "").encode("utf-8", "surrogatepass").split())) for t in texts]


def encoder(path: str, by_words: bool = True) -> WordEncoder:
    """The worker's own encoder for a vocabulary file; its memo outlives the task."""
    return held(("encoder", path, by_words), lambda: WordEncoder(path, by_words))


def batches(texts: list, doc_chars: int = 4_000_000) -> Iterable[slice]:
    """Slices of at most ``doc_chars`` characters or one text, to bound what is held at once."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= doc_chars:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))
