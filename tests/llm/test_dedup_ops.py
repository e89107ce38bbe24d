"""Similarity, line and substring dedup against brute force, and their odd inputs."""

import collections
import hashlib
import random
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelake.llm import blocks, hot, line_dedup, ngram_join, substring_dedup, words
from triagelake.llm.graph import connected_components

ODD = [(100, None), (101, ""), (102, " \n\t "), (103, "one two"), (104, "ONE two"), (105, "solo"), (106, "long " * 30_000), (107, "w" * 2_000_000), (None, "no id at all but a text"), (108, "Ünï cödé " * 5)]
SCHEMA = "doc_id long, text string, n_words string, n_cut int, set_id string, component_id int, component string"


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 80))] for _ in range(12)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    out = []
    for i in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            if text:
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            at = rng.randrange(len(text) + 1)
            text[at:at] = passage
        lines = [" ".join(text[j : j + 9]) for j in range(0, len(text), 9)]
        out.append((i, "\n".join(lines)))
    return out + [out[3], (n, out[5][1].upper()), (n + 1, out[5][1])]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, "z") for i, t in rows], SCHEMA).repartition(5)


def shingles(text):
    found = bytes((text or "").encode()).translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    return frozenset(tuple(found[i : i + 5]) for i in range(len(found) - 4)) if len(found) >= 5 else frozenset([tuple(found)] if found else [])


def components(rows, linked):
    low = {i: i for i, _ in rows if i is not None}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, x in rows:
        for b, y in rows:
            if a is not None and b is not None and a < b and linked(x, y):
                p, q = root(a), root(b)
                low[max(p, q)] = min(p, q)
    return {i: root(i) for i in low}


@pytest.fixture
def many_hot(monkeypatch):
    """Every token of a few documents counts as hot."""
    monkeypatch.setattr(hot, "LEAST", 3)
    monkeypatch.setattr(hot, "SHARE", 1e-9)


@pytest.mark.parametrize("spread", [False, True])
@pytest.mark.parametrize("frequent", [6, 1])
def test_near_duplicates_by_brute_force(spark, monkeypatch, request, frequent, spread):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    if spread:
        request.getfixturevalue("many_hot")
        monkeypatch.setattr(ngram_join, "SPLIT", 2)
    rows = corpus(frequent) + ODD
    sets = {t: shingles(t) for _, t in rows}
    link = lambda x, y: bool(sets[x]) and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y])
    wanted = components(rows, link)
    got = ngram_join.near_duplicates(frame(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == collections.Counter((i, len(sets[t]), wanted.get(i)) for i, t in rows)


def test_many_members_that_do_not_link_are_split(spark, monkeypatch):
    """Sets that share half their tokens and few others: split units hold few of them, and no link is lost."""
    rng = np.random.default_rng(8)
    common = rng.integers(1, 1 << 46, 10).astype(np.uint64)
    sets, own = [], []
    for i in range(600):
        if i % 100 == 99:  # a near copy of the one before
            tokens = np.unique(np.concatenate([own[-1][1:], rng.integers(1, 1 << 46, 1).astype(np.uint64)]))
        else:
            tokens = np.unique(np.concatenate([common, rng.integers(1, 1 << 46, 10).astype(np.uint64)]))
        own.append(tokens)
        sets.append((i, len(tokens), len(tokens), bytearray(ngram_join.sketch(tokens)), bytearray(blocks._pack(tokens, 6))))
    frame = spark.createDataFrame(sets, "set_id long, n int, size int, sketch binary, tokens binary")
    need = "n - (n * 75 + 99) div 100 + 1 - (n - size)"
    units = spark.createDataFrame([(7, i) for i in range(600)], "unit long, set_id long")
    smaller = ngram_join._split(units, frame, ngram_join.unpacked, need).select("unit", "set_id").distinct()
    sizes = [r.c for r in smaller.groupBy("unit").agg(F.count("*").alias("c")).collect()]
    assert sum(c * c for c in sizes) < 600 * 40
    monkeypatch.setattr(ngram_join, "SPLIT", 20)
    entries = frame.select("set_id", "n", F.lit(0).alias("lone"), F.lit(5).cast("long").alias("entry"))
    found = ngram_join.entry_links(entries, frame, "true", partial(ngram_join.jaccard_allows, 75), partial(ngram_join.jaccard_links, percent=75), ngram_join.unpacked, need).collect()
    assert {r.node: r.component for r in found} == {i - k: i - 1 for i in range(99, 600, 100) for k in (0, 1)}


def test_signatures_meet_for_all_linked_sets():
    rng = np.random.default_rng(5)
    for n in (3, 4, 7, 20, 60, 200):
        for _ in range(30):
            a = np.unique(rng.integers(1, 1 << 40, n).astype(np.uint64))
            lack = ngram_join.may_lack(len(a), 75)
            b = a[: len(a) - int(rng.integers(0, lack + 1))]
            ranks = dict(zip(a.tolist(), rng.integers(1, 12, len(a)).tolist(), strict=True))
            x, y = (ngram_join.signatures(len(s), s, np.array([ranks[t] for t in s.tolist()]), 75) for s in (a, b))
            assert 100 * len(b) < 75 * len(a) or np.intersect1d(x, y).size
            most = ngram_join.sketch(a), ngram_join.sketch(b)
            assert len(most[0]) >= len(most[1])


def test_bands_of_linking_sizes_are_neighbours():
    for n in range(1, 3000):
        for m in (-(-n * 75 // 100), n):
            assert 0 <= ngram_join.band(n, 75) - ngram_join.band(max(m, 1), 75) <= 1


def brute_lines(rows, edits=2, least=32):
    strip = " \t\n\v\f\r"
    seen = [(i, k, x.strip(strip)) for i, t in rows if i is not None for k, x in enumerate((t or "").split("\n")) if len(x.strip(strip)) >= least]
    kinds = sorted({x for _, _, x in seen})
    low = components(list(enumerate(kinds)), lambda x, y: abs(len(x) - len(y)) <= edits and line_dedup._by_table(x, y) <= edits)
    first = {}
    for i, k, x in seen:
        c = low[kinds.index(x)]
        first[c] = min(first.get(c, (i, k)), (i, k))
    out = collections.Counter()
    for i, t in rows:
        raw = (t or "").split("\n")
        left = [x for k, x in enumerate(raw) if not (i is not None and len(x.strip(strip)) >= least and first[low[kinds.index(x.strip(strip))]] < (i, k))]
        out[i, len(raw) if t is not None else 0, len(raw) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("spread", [False, True])
def test_lines_by_brute_force(spark, request, monkeypatch, spread):
    if spread:
        request.getfixturevalue("many_hot")
        monkeypatch.setattr(ngram_join, "SPLIT", 2)
    rng = random.Random(4)
    rows = [r for r in corpus(3, 25) if r[1]]
    for i in range(200, 240):
        line = "This line is found again and again, number five"
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(line))
            line = line[:at] + rng.choice(["", "x", "é", line[at] + "q"]) + line[at + 1 :]
        rows.append((i, f"Intro {i}\n  {line} \nshort"))
    rows += [o for o in ODD if o[0] not in (106, 107)]
    got = line_dedup.remove_lines(frame(spark, rows), digest=True).collect()
    assert collections.Counter(map(tuple, got)) == brute_lines(rows)
    plain = line_dedup.remove_lines(frame(spark, rows))
    assert plain.columns == ["doc_id", "text", "n_words", "set_id", "component_id", "component", "n_lines", "n_cut"]
    assert plain.where("n_cut > 0").count() > 0


def brute_short(rows):
    """doc_id -> text without repeated lines, where no unequal long lines are alike."""
    strip = " \t\n\v\f\r"
    first, out = {}, {}
    for i, t in sorted(rows):
        for k, x in enumerate(t.split("\n")):
            if x.strip(strip):
                first.setdefault(x.strip(strip), (i, k))
    for i, t in rows:
        out[i] = "\n".join(x for k, x in enumerate(t.split("\n")) if not x.strip(strip) or first[x.strip(strip)] == (i, k))
    return out


def test_short_lines_go_when_equal(spark, tmp_path):
    short = ["All rights reserved.", "Released under the MIT License.", "x", "été", "Licensed under CC BY-NC 4.0."]
    rows = [(i, f"Own line {i * i * 7919}\n{short[i % 5]}\n\n  {short[i % 3]} \t\n" + ("This line of boilerplate is found in each text.\n" if i % 2 else "") + f"all rights reserved{i % 2}") for i in range(30)]
    wanted = brute_short(rows)
    got = {r.doc_id: r for r in line_dedup.remove_lines(frame(spark, rows), exact_short=True).collect()}
    assert {i: r.text for i, r in got.items()} == wanted and sum(r.n_cut for r in got.values()) > 60
    apart = [(i, t.replace("all rights reserved1", "no right is reserved").replace("Own line", "Own" + "abcdefghijklmnopqrstuvwxyz0123"[i] * 4)) for i, t in rows]
    spark.createDataFrame(apart, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    from triagelake.llm.queries import op6_line_dedup

    assert {r.doc_id: r.kept_sha256 for r in op6_line_dedup(spark, str(tmp_path)).collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in brute_short(apart).items()}


def brute_scaled(rows, edits=2, full=32):
    """doc_id -> text, lines alike within edits in proportion to the shorter one's length."""
    strip = " \t\n\v\f\r"
    seen = [(i, k, x.strip(strip)) for i, t in rows for k, x in enumerate(t.split("\n")) if x.strip(strip)]
    kinds = sorted({x for _, _, x in seen})
    low = components(list(enumerate(kinds)), lambda x, y: line_dedup._by_table(x, y) <= min(edits, min(len(x), len(y)) * edits // full))
    low = {x: low[k] for k, x in enumerate(kinds)}
    first = {}
    for i, k, x in seen:
        first[low[x]] = min(first.get(low[x], (i, k)), (i, k))
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if not x.strip(strip) or first[low[x.strip(strip)]] == (i, k)) for i, t in rows}


@pytest.mark.parametrize("spread", [False, True])
def test_short_lines_within_fewer_edits(spark, request, monkeypatch, spread, tmp_path):
    if spread:
        request.getfixturevalue("many_hot")
        monkeypatch.setattr(ngram_join, "SPLIT", 2)
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdé fgh") for _ in range(n)).strip() or "x" for n in (3, 9, 14, 15, 16, 17, 18, 20, 24, 30, 31, 32, 33, 34, 40)]
    rows = []
    for i in range(24):
        lines = []
        for line in rng.sample(base, 6):
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
                at = rng.randrange(len(line) + 1)
                line = line[:at] + rng.choice(["", "x", "q", line[at : at + 1] + "y"]) + line[at + 1 :]
            lines.append(line)
        rows.append((i, "\n".join(lines)))
    wanted = brute_scaled(rows)
    assert line_dedup._by_table("released in May 2019", "released in May 2020") == 2  # 20 characters, one edit allowed
    rows += [(100, "released in May 2019"), (101, "released in May 2020"), (102, "released in Mai 2019")]
    wanted |= {100: "released in May 2019", 101: "released in May 2020", 102: ""}
    got = {r.doc_id: r.text for r in line_dedup.remove_lines(frame(spark, rows), exact_short=True, scaled=True).collect()}
    assert got == wanted and wanted == brute_scaled(rows)
    if spread:
        return
    assert got != {r.doc_id: r.text for r in line_dedup.remove_lines(frame(spark, rows), exact_short=True).collect()}
    left_alone = {r.doc_id: r.text for r in line_dedup.remove_lines(frame(spark, rows), scaled=True).collect()}
    assert left_alone[102] == "" and left_alone[101] == "released in May 2020"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    from triagelake.llm.queries import op6_line_dedup

    assert {r.doc_id: r.kept_sha256 for r in op6_line_dedup(spark, str(tmp_path)).collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in wanted.items()}


def test_long_lines_and_empty_tables(spark):
    rows = [(1, "a" * 1_200_000), (2, "a" * 1_199_999 + "b"), (3, None)]
    got = {r.doc_id: r.n_cut for r in line_dedup.remove_lines(frame(spark, rows), digest=True).collect()}
    assert got == {1: 0, 2: 1, 3: 0}
    none = frame(spark, rows).limit(0)
    assert line_dedup.remove_lines(none).count() == substring_dedup.remove_repeats(none).count() == ngram_join.near_duplicates(none).count() == 0


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(edits):
    rng = random.Random(edits)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "cc"])
        b = "".join(b)
        assert line_dedup.within(a, b, edits) == (line_dedup._by_table(a, b) <= edits), (a, b)


def test_no_edits_are_equality():
    assert line_dedup.within("And to", "And to", 0) and not line_dedup.within("And to", "It and", 0)
    assert not line_dedup.within("abc", "abd", 0) and not line_dedup.within("", "a", 0)


def brute_windows(rows, size=13):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        found = (t or "").encode().split()
        for j in range(len(found) - size + 1):
            first.setdefault(tuple(found[j : j + size]), i)
    out = collections.Counter()
    for i, t in rows:
        found = (t or "").encode().split()
        gone = set()
        for j in range(len(found) - size + 1):
            if i is not None and first[tuple(found[j : j + size])] < i:
                gone.update(range(j, j + size))
        kept = [x for j, x in enumerate(found) if j not in gone]
        out[i, len(found), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("spread", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_windows_by_brute_force(spark, request, seed, spread):
    if spread:
        request.getfixturevalue("many_hot")
    rows = corpus(seed) + ODD
    got = substring_dedup.remove_repeats(frame(spark, rows).select("doc_id", "text"), digest=True).collect()
    assert collections.Counter(map(tuple, got)) == brute_windows(rows)


def uneven(blocks_frame):
    """The largest partition's bytes of blocks, as a multiple of the median's."""
    sizes = sorted(r.b for r in blocks_frame.groupBy("part").agg(F.sum(F.length("data")).alias("b")).collect())
    return sizes[-1] / sizes[len(sizes) // 2]


def test_a_passage_that_all_documents_share_is_spread(spark, monkeypatch):
    """20 words in every document, and one beginning in every line: no partition holds three times the median."""
    parts = 96
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    monkeypatch.setattr(hot, "SAMPLE", 4)
    try:
        rng = random.Random(3)
        own = lambda n: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(n))
        passage = own(20)
        docs = spark.createDataFrame([(i, f"{own(20)} {passage} {own(20)}") for i in range(900)], "doc_id long, text string").repartition(4)
        for units, tokens_of, post in (
            (docs.select("text"), partial(ngram_join.shingles_of, k=5), lambda h: docs.select("text").mapInArrow(partial(ngram_join._postings, k=5, parts=parts, least=1, hot=h), blocks.SCHEMA)),
            (docs.select("text"), partial(substring_dedup.all_of, each=substring_dedup.anchors_of, window=13), lambda h: docs.mapInArrow(partial(substring_dedup._anchor_postings, window=13, parts=parts, hot=h), blocks.SCHEMA)),
        ):
            found = hot.find_in(units, tokens_of)
            assert 0 < len(found) <= parts / hot.SHARE
            assert uneven(post(found)) < 3 < uneven(post(blocks.NONE))
        lines = spark.createDataFrame([(i, "\n".join(f"Written by the author named {own(3)}" for _ in range(4))) for i in range(900)], "doc_id long, text string").repartition(4)
        units = lines.mapInArrow(partial(line_dedup._occurrences, min_chars=32, exact_short=False, share=hot.share_of(lines)), "set_id long, doc_id long, line int, unit binary")
        assert units.where("set_id is not null").count() == 3600 and 1000 < units.where("unit is not null").count() < 2200
        found = hot.find(units.where("unit is not null").select("unit"), partial(line_dedup.all_entries, edits=2), distinct=True)
        post = lambda h: lines.select("text").mapInArrow(partial(line_dedup._entry_postings, min_chars=32, edits=2, parts=parts, hot=h), blocks.SCHEMA)
        assert 0 < len(found) and uneven(post(found)) < 3 < uneven(post(blocks.NONE))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 3)


def test_kept_text_and_columns(spark):
    repeated = " ".join(f"r{i}" for i in range(13))
    rows = [(1, f"a\n{repeated} b"), (2, f"  x y\t{repeated}\n\nz"), (3, None)]
    got = substring_dedup.remove_repeats(frame(spark, rows))
    assert got.columns == ["doc_id", "text", "n_cut", "set_id", "component_id", "component", "n_words", "n_removed"]
    assert {r.doc_id: (r.text, r.n_removed) for r in got.collect()} == {1: (rows[0][1], 0), 2: ("x y\tz", 13), 3: (None, 0)}


def test_cover_aligns_any_two_positions():
    for i in range(7):
        for j in range(7):
            assert any(substring_dedup.COVER[(i + d) % 7] and substring_dedup.COVER[(j + d) % 7] for d in range(7))


def test_word_hashes_ignore_where_words_stand():
    text = ("Alpha beta  gamma\n" * 40_000).encode()
    found = words.hash_words(text)
    assert len(found) == 120_000 and len(np.unique(found)) == 3
    giant = b"x" * 1_500_000
    mixed = words.hash_words(b"alpha " + giant + b" Alpha", lower=True)
    assert mixed[0] == mixed[2] == words.hash_words(b"alpha")[0] and mixed[1] == words.hash_words(giant)[0]
    assert len(words.hash_words(b" \n")) == 0


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(5, 5), (None, 3), (7, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 7: 7, **{i: 7 for i in range(200, 260)}}


def test_partitions_follow_the_input(spark, monkeypatch, tmp_path):
    """Many more partitions than the session asks for, as large inputs get them: the same results."""
    from triagelake.llm import common

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    run = lambda: [sorted(map(tuple, f(docs.select("doc_id", "text")).collect())) for f in (ngram_join.near_duplicates, lambda d: line_dedup.remove_lines(d, digest=True, exact_short=True), lambda d: substring_dedup.remove_repeats(d, digest=True))]
    wanted = run()
    assert common.partitions_for(docs) == common.partitions(spark) == 3
    assert common.partitions_for(spark.createDataFrame([(1,)], "a int")) == 3
    monkeypatch.setattr(common, "PARTITION_BYTES", int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // 17)
    assert common.partitions_for(docs) >= 17
    assert run() == wanted


def test_a_cluster_must_name_the_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from triagelake.llm import common

    there = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(there, "x")
