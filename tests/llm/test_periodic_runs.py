"""Periodic runs against brute force over every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from triagelake.llm import periodic_runs
from triagelake.llm.queries import queries

SMALL = "/root/testdata/sf0.001"


def brute_runs(words, least=12):
    n, smallest = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            size = j - i + p
            if j > i and size >= max(least, 2 * p):
                smallest.setdefault((i, size), p)
            i = j + 1
    return sorted(((s, size, p) for (s, size), p in smallest.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {i for s, size, p in runs for i in range(s + p, s + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def brute_row(doc_id, words):
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    listed = sha("".join(f"{s},{size},{p}\n" for s, size, p in runs))
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, listed, sha(brute_collapsed(words, runs)))


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(800):
        n, k = rng.randint(0, 80), rng.choice([1, 2, 2, 3, 5, 9])
        words = [rng.randrange(k) for _ in range(n)]
        if n > 10 and rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randint(1, 12)
            words = [words[i] if i < a else words[min(n - 1, a + (i - a) % p)] for i in range(n)]
        if rng.random() < 0.4:
            words = words + words[: rng.randint(0, len(words))] + words
        for least in (6, 12):
            assert [tuple(r) for r in periodic_runs.runs_of(np.array(words, np.int64), least).tolist()] == brute_runs(words, least)
    with pytest.raises(ValueError):
        periodic_runs.runs_of(np.arange(3), 5)


def test_runs_of_structured_words():
    a, b = "0", "01"
    while len(b) < 700:
        a, b = b, b + a
    thue = [bin(i).count("1") % 2 for i in range(512)]
    for words in (list(b), thue, [0] * 500, [0, 1] * 300, list("abcabcabdabcabcabd" * 12)):
        numbers = np.unique(np.array(words), return_inverse=True)[1].astype(np.int64)
        assert [tuple(r) for r in periodic_runs.runs_of(numbers).tolist()] == brute_runs(words)


def test_previous_factors_by_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        words = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randint(1, 40))]
        levels, rank = periodic_runs.block_classes(np.array(words, np.int64))
        lpf, source = periodic_runs.previous_factors(levels, rank)
        for i in range(len(words)):
            match = lambda j, i=i: next((k for k in range(len(words) - i) if words[j + k] != words[i + k]), len(words) - i)
            assert lpf[i] == max(map(match, range(i)), default=0)
            assert lpf[i] == 0 or (source[i] < i and match(source[i]) == lpf[i])


ODD = [
    (None, "a b a b a b a b a b a b a b"), (1, None), (2, ""), (3, " \t\n "), (4, "x " * 30), (4, "x " * 30), (5, "a b c " * 5 + "q " + "b a " * 9), (6, "ü ü ü ü " * 8),
    (7, ("lorem ipsum dolor " * 7 + "end. ") * 3), (8, "w" * 20_000 + " z" * 13), (9, " ".join(str(i % 700) for i in range(3000))), (10, "A a " * 6 + "A a\x1cA a A"),
]


def test_find_runs_of_odd_rows(spark):
    frame = spark.createDataFrame([(i, t, "kept", 1, None) for i, t in ODD], "doc_id long, text string, text_of_runs string, runs int, lang string").repartition(3)
    found = periodic_runs.find_runs(frame)
    assert found.columns == ["doc_id", "text", "text_of_runs", "lang", "runs", "collapsed"]
    got = sorted(((r.doc_id, r.text, [tuple(x) for x in r.runs], r.collapsed, r.text_of_runs, r.lang) for r in found.collect()), key=str)
    wanted = []
    for i, t in ODD:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = brute_runs(words)
        wanted.append((i, t, runs, brute_collapsed(words, runs), "kept", None))
    assert got == sorted(wanted, key=str)
    digest = periodic_runs.run_digest(found)
    assert sorted(map(tuple, digest.collect()), key=str) == sorted((brute_row(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in ODD), key=str)
    assert periodic_runs.run_digest(periodic_runs.find_runs(frame.limit(0))).count() == 0


def test_small_batches_give_the_same(spark, monkeypatch):
    texts = [(t or "").encode() for _, t in ODD]
    whole = [(r.tolist(), t) for r, t in periodic_runs._collapse(texts, 12)]
    assert whole == [(r.tolist(), t) for one in texts for r, t in periodic_runs._collapse([one], 12)]


def test_query_by_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 6000")
    docs = docs.unionByName(spark.createDataFrame([(i, t) for i, t in ODD], "doc_id long, text string"), allowMissingColumns=True)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries()["op12_periodic_runs"](spark, str(tmp_path)).collect()), key=str)
    rows = docs.select("doc_id", "text").collect()
    assert got == sorted((brute_row(r.doc_id, planted(r.doc_id, r.text)) for r in rows), key=str)
    assert sum(r[1] > 0 for r in got) > len(rows) / 20
