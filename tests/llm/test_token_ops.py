"""Encoding, record files, packing and SentencePiece against the libraries and by hand."""

import collections
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from triagelake.llm import common, packing, rows, sentencepiece_fst, token_records
from triagelake.llm.tokenize import WordEncoder

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "Hello  world\n\té the", "", "   ", " a", "▁x▁▁y", "日本語 テスト 🙂", "\x00\x01 \x1c\x85\xa0b", "don't  stop 12345 ½ Σας ΟΔΟΣ İstanbul",
    "a" * 5000, "word " * 3000, "<|endoftext|> foo<|endoftext|>bar", "é. É, ñ·l à-b L'ÉTÉ aª Ǆ ﬁ", "\r\nfoo... bar!!! ###",
]
SCHEMA = "doc_id long, text string, length int, offset int, start string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(10 * i, t, 1, 2, "x") for i, t in enumerate(ODD)] + [(10, ODD[1], 1, 2, "x"), (10, ODD[0], 0, 0, None), (None, "no id", 0, 0, None), (7, None, 0, 0, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def library_ids(text):
    return [*Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_encoder_equals_library():
    encoder, tokenizer = WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    assert encoder.cut_marks
    for text, ids in zip(ODD, encoder.encode_many(ODD), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
    whole = WordEncoder(public_tokenizers.path("byte_bpe_50k.json"), by_words=False)
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert np.frombuffer(whole.encode_many([ODD[0]])[0], "<u4").tolist() == other.encode(ODD[0], add_special_tokens=False).ids


def test_frames_round_trip_and_damage():
    payload = token_records.payload_of(5, np.array([1, 2, 65535], "<u4").tobytes(), 2)
    data = token_records.frame(payload) + token_records.frame(b"") + b"\n"
    assert [bytes(p) for _, p in token_records.frames(data)] == [payload, b""]
    doc_id, ids = token_records.ids_of(payload)
    assert doc_id == 5 and ids.tolist() == [1, 2, 65535]
    for at in (0, 9, 14, len(data) - 3):
        with pytest.raises(ValueError):
            list(token_records.frames(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]))


def test_records_hold_all_documents_in_order(spark, docs, tmp_path):
    out = f"file://{tmp_path}/records"
    token_records.write_records(docs, out, WORDS, chunk_bytes=4000)
    index = token_records.write_index(spark, out, f"file://{tmp_path}/index")
    rows = token_records.with_starts(index).orderBy("start").collect()
    given = docs.select("doc_id", "text").collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == collections.Counter((g.doc_id, len(i := library_ids(g.text)), crc(i)) for g in given)
    assert [r.doc_id for r in rows] == sorted((g.doc_id for g in given), key=lambda x: (x is not None, x))
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    by_text = [(g.doc_id, crc(library_ids(g.text))) for g in sorted(given, key=lambda g: (g.doc_id is not None, g.doc_id or 0, g.text is not None, (g.text or "").encode()))]
    assert [(r.doc_id, r.ids_crc32) for r in rows] == by_text
    read = token_records.shuffled_read(spark, out, index, 3).orderBy("place").collect()
    assert collections.Counter((r.doc_id, crc(r.ids)) for r in read) == collections.Counter((r.doc_id, r.ids_crc32) for r in rows)
    assert [r.doc_id for r in read] != [r.doc_id for r in rows]


def test_pack_histogram_places_every_length():
    counts = {2047: 3, 1500: 10, 700: 25, 500: 7, 48: 100, 3: 1}
    patterns = packing.pack_histogram(counts, 2048)
    placed = collections.Counter()
    for pattern, n in patterns:
        assert sum(pattern) <= 2048
        for length in pattern:
            placed[length] += n
    assert placed == counts
    assert packing.pack_histogram({}, 2048) == []


def test_packing_is_gapless_and_whole(docs):
    rows = packing.pack_documents(docs, WORDS, 256).collect()
    wanted = collections.Counter()
    for g in docs.select("doc_id", "text").collect():
        ids = library_ids(g.text)
        for start in range(0, len(ids), 256):
            part = ids[start : start + 256]
            wanted[g.doc_id, start, len(part), crc(part), len(ids)] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == wanted
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    totals = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
        totals.append(at)
    assert sorted(sequences) == list(range(len(sequences)))
    assert all(a + b > 256 for i, a in enumerate(totals) for b in totals[:i])  # no two could be one


def test_texts_reach_workers_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    wide = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 1000).alias("text"))
    sizes = lambda rows: (pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"]) for b in rows)
    stages = dict(pytest.importorskip("corpus_pipeline").STAGES)
    for start in (lambda: packing.token_pieces(wide, WORDS, 2048), lambda: stages["language"](spark, wide.selectExpr("*", "cast(null as string) lang", "'' source", "0L n_chars"), "")):
        spark.conf.unset(name)
        start()
        got = wide.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r.n for r in got) == 3000 and max(r.size for r in got) < 2 * common.BATCH_BYTES
    spark.conf.set(name, "1m")
    common.small_batches(spark)
    assert spark.conf.get(name) in ("1m", "1048576b")
    spark.conf.unset(name)


def test_small_batches_are_joined_before_they_are_dealt():
    whole = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(["w" * 100] * 100)], ["doc_id", "text"])
    some = [whole.slice(i, 5) for i in range(0, 100, 5)]
    joined = list(rows.together(iter([*some, whole.slice(0, 0)]), 2500))
    assert pa.Table.from_batches(joined).equals(pa.Table.from_batches([whole])) and 2 <= len(joined) <= 6
    assert list(rows.pack_rows(iter([]), 3)) == [] and len(list(rows.pack_rows(iter(some), 3))) == 3


def test_padding_is_little():
    rng = random.Random(1)
    for most in (16, 256, 2048):
        counts = collections.Counter(min(most, int(rng.expovariate(4 / most)) + 1) for _ in range(5000))
        patterns = packing.pack_histogram(counts, most)
        tokens = sum(k * n for k, n in counts.items())
        padded = sum(n * (0 if (t := sum(p)) == most or t & (t - 1) == 0 else most - t) for p, n in patterns)
        assert packing.pad_of(patterns, most) == padded < (0.02 if most > 256 else 0.15) * tokens


def test_empty_tables(spark, docs, tmp_path):
    none = docs.limit(0)
    assert packing.pack_documents(none, WORDS).count() == 0
    assert sentencepiece_fst.encode_and_decode(none, PIECES).count() == 0
    token_records.write_records(none, f"file://{tmp_path}/none", WORDS)
    assert token_records.scan_records(spark, f"file://{tmp_path}/none").count() == 0


def test_sentencepiece_equals_library(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    machine = sentencepiece_fst.Model(PIECES)
    for text in ODD:
        ids = machine.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text), text
        assert machine.decode(ids) == library.decode(library.encode(text)), text
    corpus = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert [np.frombuffer(machine.encode(t), "<u4").tolist() for t in corpus] == library.encode(corpus)
    back = sentencepiece_fst.decode(sentencepiece_fst.encode(docs, PIECES), PIECES).collect()
    assert collections.Counter((r.doc_id, r.text) for r in back) == collections.Counter((g.doc_id, (g.text or "").replace("▁", " ")) for g in docs.collect())


def field(number, value):
    """One field of a protocol buffer message."""
    size = lambda n: bytes([n & 127 | 128]) + size(n >> 7) if n > 127 else bytes([n])
    if isinstance(value, int):
        return size(number << 3) + size(value)
    if isinstance(value, float):
        return size(number << 3 | 5) + struct.pack("<f", value)
    return size(number << 3 | 2) + size(len(value)) + value


def model_file(path, kind, pieces, byte_fallback, prefix, squeeze):
    """A model written by hand: (piece, score) of the normal ones, beside the unknown one and the bytes."""
    listed = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256) if byte_fallback] + [(p, x, 1) for p, x in pieces]
    data = b"".join(field(1, field(1, p.encode()) + field(2, x) + field(3, t)) for p, x, t in listed)
    data += field(2, field(3, kind) + field(4, len(listed)) + field(35, int(byte_fallback)))
    data += field(3, field(1, b"identity") + field(2, b"") + field(3, int(prefix)) + field(4, int(squeeze)) + field(5, 1))
    path.write_bytes(data)
    return str(path)


@pytest.mark.parametrize("kind", [sentencepiece_fst.UNIGRAM, sentencepiece_fst.BPE])
@pytest.mark.parametrize(("byte_fallback", "prefix", "squeeze"), [(True, True, False), (True, False, True), (False, True, True), (False, False, False)])
def test_hand_made_models_equal_library(tmp_path, kind, byte_fallback, prefix, squeeze):
    rng = random.Random(3)
    texts = {"▁", *"abcd", "é", "▁▁"}
    while len(texts) < 60:  # every piece joins two others, as merging needs
        a, b = rng.choice(sorted(texts)), rng.choice(sorted(texts))
        if len(a + b) <= 6 and "▁" not in b:
            texts.add(a + b)
    order = sorted(texts, key=lambda t: (len(t), rng.random()))
    # different sums for different paths: unigram scores are powers apart, byte-pair scores ranks
    pieces = [(t, -(i + 1.0) if kind == sentencepiece_fst.BPE else -4.0 - len(t) - rng.randrange(1 << 12) / (1 << 10)) for i, t in enumerate(order)]
    path = model_file(tmp_path / "m.model", kind, pieces, byte_fallback, prefix, squeeze)
    library, machine = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_fst.Model(path)
    inputs = ["", " ", "   ", "a", " a  b ", "xyz é日本 日", "▁a▁ b▁", "ab▁▁cd", "\ta\nb c", *("".join(rng.choice("aabbccdé  x") for _ in range(rng.randint(1, 40))) for _ in range(300))]
    for text in inputs:
        ids = machine.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text), text
        assert machine.decode(ids) == library.decode(library.encode(text)), text


def test_shortest_path_is_the_lightest_of_all():
    rng = random.Random(5)
    for flat in (False, True):
        for _ in range(200):
            weights = {p: 0.0 if flat else rng.randrange(9) / 4 for p in {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(6)}}
            machine = sentencepiece_fst.Pieces(weights, 0.0 if flat else 3.0)
            text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))
            weigh = lambda parts: sum(weights.get(p, 0.0 if flat else 3.0) for p in parts)  # noqa: B023, E731
            ways = [split(text, cut) for cut in range(1 << max(0, len(text) - 1))] if text else [[]]
            best = min(weigh(parts) for parts in ways if all(p in weights or len(p) == 1 for p in parts))
            got = sentencepiece_fst.shortest_path(text, machine, sentencepiece_fst.AnyNeighbours())
            assert "".join(got) == text and weigh(got) == best


def test_normaliser_states():
    plain, squeezed = sentencepiece_fst.Normaliser(True, False), sentencepiece_fst.Normaliser(True, True)
    assert plain.run(plain.START, "  a b ") == (plain.BODY, "▁▁▁a▁b▁")
    assert squeezed.run(squeezed.START, "  a  b ") == (squeezed.GAP, "▁a▁b")
    assert squeezed.run(squeezed.BODY, " c") == (squeezed.BODY, "▁c")


def test_very_long_words(spark, tmp_path):
    """Words of millions of characters through all three encoders."""
    rng = random.Random(9)
    texts = ["a" * 2_000_000, "".join(rng.choice("etaoinsh") for _ in range(2_000_000)), "日本é" * 300_000]
    library, machine = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepiece_fst.Model(PIECES)
    for t in texts[1:]:
        assert np.frombuffer(machine.encode(t), "<u4").tolist() == library.encode(t)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    wanted = {i: library_ids(t) for i, t in enumerate(texts)}
    pieces = collections.defaultdict(dict)
    for r in packing.pack_documents(frame, WORDS).collect():
        pieces[r.doc_id][r.start] = (r.length, r.ids_crc32)
    for i, ids in wanted.items():
        assert pieces[i] == {at: (len(ids[at : at + 2048]), crc(ids[at : at + 2048])) for at in range(0, len(ids), 2048)}
    out = f"file://{tmp_path}/long"
    token_records.write_records(frame, out, WORDS)
    assert {r.doc_id: r.ids_crc32 for r in token_records.scan_records(spark, out).collect()} == {i: crc(ids) for i, ids in wanted.items()}


def split(word, cut):
    parts, at = [], 0
    for i in range(1, len(word)):
        if cut >> (i - 1) & 1:
            parts.append(word[at:i])
            at = i
    return [*parts, word[at:]]
