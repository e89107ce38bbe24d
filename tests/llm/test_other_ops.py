"""Neighbours, URL filter, fingerprints, language identification and the pipeline."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelake.llm import langid, neighbours, url_filter, winnowing

SMALL = "/root/testdata/sf0.001"


def test_neighbours_by_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(120, 9)).astype(np.float32)
    vectors[40:80] = vectors[40]
    rows = [(i, [float(x) for x in v], "clash") for i, v in enumerate(vectors)]
    odd = [(200, None, ""), (201, [0.0] * 9, ""), (202, [math.nan] * 9, ""), (203, [None] + [1.0] * 8, ""), (204, [math.inf] * 9, ""), (205, [], ""), (206, [1.0, 2.0], ""), (None, [1.0] * 9, "")]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score string").repartition(5)
    got = [tuple(r) for r in neighbours.nearest(frame, F.col("vec_id") % 20 == 0, 7).orderBy("query_id", "rank").collect()]
    wide = vectors.astype(np.float64)
    wanted = []
    for q in range(0, 120, 20):
        scores = neighbours.exact(np.repeat(wide[q : q + 1], 120, 0), wide)
        order = sorted((i for i in range(120) if i != q), key=lambda i: (-scores[i], i))[:7]
        wanted += [(q, rank, i, scores[i]) for rank, i in enumerate(order, 1)]
    assert got == wanted
    assert neighbours.nearest(frame.limit(0), F.col("vec_id") % 20 == 0, 7).count() == 0
    few = neighbours.nearest(frame.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 20 == 0, 7).collect()
    assert len(few) == 2


def test_bounds_hold():
    rng = np.random.default_rng(4)
    whole = lambda n, d, most: rng.integers(-most, most + 1, (n, d)).astype(np.float64)
    pairs = [(rng.normal(size=(50, 64)), rng.normal(size=(60, 64)) * 100)]
    pairs += [(whole(80, d, m) * a, whole(90, d, m) * b) for d in (1, 3, 64) for m in (1, 100, 127) for a, b in ((1, 1), (1e3, 1e3), (0.1, 1e9), (1e-150, 1e-150))]
    for a, b in pairs:
        (qa, sa, la), (qb, sb, lb) = neighbours.quantise(a), neighbours.quantise(b)
        near = (qa.astype(float) @ qb.T.astype(float)) * (sa[:, None] * sb)
        scores = np.stack([neighbours.exact(np.repeat(x[None], len(b), 0), b) for x in a])
        assert (np.abs(scores - near) <= neighbours.slack(a, sa, la, qa, b, lb)).all()


def brute_best(q_ids, q, c_ids, c, k):
    out = []
    for i, x in zip(q_ids.tolist(), q, strict=True):
        scores = neighbours.exact(np.repeat(x[None], len(c), 0), c)
        out += [(i, j, s) for s, j in sorted(((s, j) for s, j in zip(scores.tolist(), c_ids.tolist(), strict=True) if j != i), key=lambda r: (-r[0], r[1]))[:k]]
    return out


def test_equal_scores_of_long_vectors_go_by_id():
    """Different vectors with the same score: the smaller id stays, however long the vectors are."""
    one = lambda *v: np.array([v], np.float64)
    got = list(neighbours.cell_best(np.array([9]), one(1001, 1001, 1001), np.array([0, 1]), np.concatenate([one(101, 101, 101), one(303, 0, 0)]), 1))
    assert [(q.tolist(), c.tolist(), s.tolist()) for q, c, s in got] == [([9], [0], [303303.0])]
    rng = np.random.default_rng(12)
    for amplitude in (1, 7, 1e3, 1e6, 0.001):
        for k in (1, 2, 5):
            q, c = rng.integers(-3, 4, (40, 3)) * amplitude, rng.integers(-3, 4, (130, 3)) * amplitude
            q_ids, c_ids = np.arange(100, 140), rng.permutation(130)
            found = [x for part in neighbours.cell_best(q_ids, q, c_ids, c, k) for x in zip(*(y.tolist() for y in part), strict=True)]
            assert found == brute_best(q_ids, q, c_ids, c, k)


RULES = (url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "example.com", "/en/"), url_filter.Rule("allow", "www.example.com", "/en/"), url_filter.Rule("block", "net", "/es/"))


def test_urls(spark):
    cases = {
        "http://A.Example.COM/en/1?x=/": ("a.example.com", "/en/1", "example.com/en/", "block"),
        "https://b.www.example.com/en/#top": ("b.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://xcom/": ("xcom", "/", None, None),
        "http://a.com": ("a.com", "", None, None),
        "http://a.com?x://b.net/es/": ("a.com", "", None, None),
        "no scheme": ("", "", None, None),
        "": ("", "", None, None),
        None: ("", "", None, None),
        "ftp://q.net/es/ü\nx": ("q.net", "/es/ü\nx", "net/es/", "block"),
        "x://ÄB.net": ("Äb.net", "", None, None),
    }
    rows = [(i, u, 1, "x") for i, u in enumerate(cases)] + [(0, next(iter(cases)), 1, "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, verdict int, host string")
    got = url_filter.judge(frame, RULES, min_support=0.1).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = cases[r.url]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert url_filter.judge(frame.limit(0), RULES).count() == 0


def test_mined_rules_judge_the_rest(spark):
    rows = [([f"host:h{i % 3}", "path:spam", f"path:{i}"], "block") for i in range(60)] + [([f"host:h{i % 3}", f"path:{i}"], "allow") for i in range(60)]
    mined = url_filter.mine(spark.createDataFrame([*rows, (None, "block"), (["x"], None)], "tokens array<string>, verdict string"), 0.05, 0.8)
    assert [(m.tokens, m.verdict) for m in mined] == [(("path:spam",), "block")]
    tokens = spark.createDataFrame([(["path:spam", "a"],), (["a"],), ([],)], "t array<string>")
    assert [r.v for r in tokens.select(url_filter.by_mined(F.col("t"), mined).alias("v")).collect()] == ["block", None, None]


def test_rules_from_given_labels_on_pages_held_out(spark):
    """Spam by two combinations of tokens, labels of their own with a tenth of noise: rules from half of them are right on the other half."""
    rng = random.Random(9)
    pages = []
    for i in range(800):
        host, path = rng.choice(["shop", "news", "casino"]) + rng.choice([".org", ".io"]), rng.choice(["win", "post", "pills"])
        spam = (host.startswith("casino") and path == "win") or (host.endswith(".io") and path == "pills")
        told = spam != (rng.random() < 0.1)
        pages.append((i, f"http://{host}/{path}/{i}", "block" if told else "allow", "block" if spam else "allow"))
    frame = spark.createDataFrame(pages, "page_id long, url string, verdict string, truth string")
    labels = frame.where("page_id % 2 = 0").select("url", "verdict").unionByName(spark.createDataFrame([(None, "block"), ("http://x/", None)], "url string, verdict string"))
    got = url_filter.judge(frame.where("page_id % 2 = 1").withColumn("explicit", F.lit(1)), RULES, labels=labels, min_support=0.02, min_confidence=0.75)
    assert "explicit" in got.columns
    rows = got.collect()
    blocked = [r for r in rows if r.verdict == "block"]
    assert sum(r.truth == "block" for r in blocked) / len(blocked) > 0.97 and len(blocked) / sum(r.truth == "block" for r in rows) > 0.97
    assert url_filter.judge(frame.select("page_id", "url"), RULES, labels=labels.limit(0)).where("verdict = 'block'").count() == 0


def brute_rules(rows, min_support, min_confidence, longest):
    """Rules by counting every set of tokens in every row, then dropping what a better rule with fewer tokens makes needless."""
    from itertools import combinations

    rows = [(frozenset(t), v) for t, v in rows if t]
    by_token = {t: frozenset(i for i, (x, _) in enumerate(rows) if t in x) for t in set().union(*(t for t, _ in rows))}
    first = {}
    for t in sorted(by_token):
        first.setdefault(by_token[t], t)
    rows = [(sorted(x & set(first.values())), v) for x, v in rows]
    all_, each = {}, {}
    for x, v in rows:
        for n in range(1, min(longest, len(x)) + 1):
            for s in combinations(x, n):
                all_[s] = all_.get(s, 0) + 1
                each[s, v] = each.get((s, v), 0) + 1
    least = math.ceil(len(rows) * min_support)
    rules = [(s, v, n / all_[s], n / len(rows)) for (s, v), n in each.items() if n >= least and n / all_[s] >= min_confidence]
    kept = []
    for s, v, c, p in sorted(rules, key=lambda r: (-r[2], -r[3], len(r[0]), r[0])):
        if not any(set(k) <= set(s) for k, *_ in kept):
            kept.append((s, v, round(c, 9), round(p, 9)))
    return kept


@pytest.mark.parametrize("wide", [12, 0])
@pytest.mark.parametrize(("seed", "longest"), [(1, 3), (2, 3), (3, 9), (4, 1)])
def test_mined_rules_by_brute_force(spark, monkeypatch, wide, seed, longest):
    monkeypatch.setattr(url_filter, "WIDE", wide)
    rng = random.Random(seed)
    rows = []
    for _ in range(150):
        tokens = [t for t in "abcdefg" if rng.random() < 0.45]
        bad = ("a" in tokens and "b" in tokens and rng.random() < 0.95) or ("c" in tokens and "d" not in tokens and rng.random() < 0.9) or rng.random() < 0.1
        tokens += ["twin of a"] * ("a" in tokens) + ["twin of all"] + ["spam"] * (bad and rng.random() < 0.5)
        rows.append((rng.sample(tokens, len(tokens)), "block" if bad else "allow"))
    frame = spark.createDataFrame([*rows, (None, "block"), (["x"], None), ([], "allow")], "tokens array<string>, verdict string")
    got = [(m.tokens, m.verdict, round(m.confidence, 9), round(m.support, 9)) for m in url_filter.mine(frame, 0.04, 0.8, longest)]
    assert got == brute_rules(rows, 0.04, 0.8, longest)
    assert longest == 1 or any(len(t) > 1 for t, *_ in got)


def test_mining_ends_on_long_and_equal_urls(spark):
    """60 path parts: equal in 100,000 rows, and each URL without one part of its own."""
    parts = [f"path:{i}" for i in range(60)]
    equal = spark.range(100_000).select(F.array(*map(F.lit, parts)).alias("tokens"), F.when(F.col("id") % 4 == 0, "allow").otherwise("block").alias("verdict"))
    assert url_filter.mine(equal, 0.005, 0.9) == []
    assert [(m.tokens, m.verdict) for m in url_filter.mine(equal, 0.005, 0.7)] == [(("path:0",), "block")]
    lacking = [([p for j, p in enumerate(parts) if j != i % 60], "block" if i % 60 == 7 else "allow") for i in range(240)]
    got = url_filter.mine(spark.createDataFrame(lacking, "tokens array<string>, verdict string"), 0.01, 0.99, 2)
    assert [(m.tokens, m.verdict, m.confidence) for m in got] == [(("path:7",), "allow", 1.0)]
    urls = [(i, "http://a.example.com/" + "/".join(f"s{j}" for j in range(2000)) + f"/{i}") for i in range(30)] + [(99, "http://b.net/es/" + "x" * 1_000_000)]
    judged = url_filter.judge(spark.createDataFrame(urls, "page_id long, url string"), RULES).collect()
    assert len(judged) == 31 and {r.verdict for r in judged} == {"allow", "block"}


def test_mined_rules_do_not_restate_the_explicit_ones(spark):
    urls = [f"http://a{i}.example.net/{'es' if i % 2 else 'fr'}/{i}{'/cheap-pills' if i % 5 == 0 else ''}" for i in range(40)] + [f"http://b{i}.site.com/de/{i}" for i in range(40)]
    urls += [f"http://c{i}.example.net/en/{i}" for i in range(10)] + [f"http://d{i}.other.org/en/{i}/cheap-pills" for i in range(5)]
    rules = (*RULES, url_filter.Rule("block", "net", "/fr/"))
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(frame, rules, min_support=0.05).collect()}
    assert [got[i] for i in range(80, 90)] == ["allow"] * 10 and [got[i] for i in range(90, 95)] == ["block"] * 5


def brute_grams(text, k):
    """The polynomial hashes of k words, each by its definition, from the words' hashes that Spark computes."""
    import xxhash

    signed = lambda v: v - (1 << 64) if v >> 63 else v
    words = [signed(xxhash.xxh64_intdigest(w, 42)) % winnowing.PRIME for w in text.encode().split()]
    if 0 < len(words) < k:
        seed = 42
        for w in words:  # a list of longs is hashed by chaining seeds
            seed = xxhash.xxh64_intdigest(w.to_bytes(8, "little"), seed)
        return [signed(seed) % winnowing.PRIME]
    return [sum(w * pow(winnowing.BASE, k - 1 - j, winnowing.PRIME) for j, w in enumerate(words[i : i + k])) % winnowing.PRIME for i in range(len(words) - k + 1)]


def brute_winnow(text, k, window):
    """(hash, place) of the least of each window, of equal ones the rightmost."""
    hashes = brute_grams(text, k)
    whole = [(h, -i) for i, h in enumerate(hashes)]
    least = [min(whole[a : a + window]) for a in range(max(1, len(whole) - window + 1))] if whole else []
    return [(h, -i) for h, i in dict.fromkeys(least)]


def as_text(found):
    return "".join(f"{((h - winnowing.MIDDLE) * (1 << 30) + (1 << 30) - 1 - i) & (1 << 64) - 1:016X}" for h, i in found)


def brute_likeness(a, b):
    x, y = {h for h, _ in a}, {h for h, _ in b}
    return len(x & y) / len(x | y) if x or y else 1.0


@pytest.mark.parametrize(("k", "window"), [(1, 1), (2, 3), (3, 4), (5, 16), (8, 7), (13, 2)])
def test_winnowing(spark, k, window):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcde") for _ in range(n)) for n in (0, 1, 2, 4, 5, 6, 13, 20, 21, 30, 200)] + ["é ü\tß\n日本", "same " * 40]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    kept = winnowing.winnow(F.col("t"), k, window)
    both = F.transform(kept, lambda e: F.struct(winnowing.hash_of(e), winnowing.place_of(e)))
    for r in frame.select(winnowing.gram_hashes(F.col("t"), k).alias("g"), both.alias("w"), winnowing.fingerprint_text(kept).alias("f"), "t").collect():
        assert r.g == brute_grams(r.t, k)
        assert [tuple(x) for x in r.w] == brute_winnow(r.t, k, window)
        assert r.f == as_text(brute_winnow(r.t, k, window))
        for left, right in zip(r.g, r.g[1:], strict=False):  # they roll: one word out, one in
            assert len(r.t.split()) <= k or right in {(winnowing.BASE * left - pow(winnowing.BASE, k, winnowing.PRIME) * a + b) % winnowing.PRIME for a in brute_grams(r.t, 1) for b in brute_grams(r.t, 1)}


def test_every_place_fits(spark):
    ends = spark.createDataFrame([(h, i) for h in (0, 1, winnowing.PRIME - 1) for i in (0, 1, (1 << 26) + 5, (1 << 30) - 1)], "h long, i int")
    e = (F.col("h") - winnowing.MIDDLE) * F.lit(1 << 30) + F.lit(winnowing.PLACES) - F.col("i")
    rows = ends.select("h", "i", e.alias("e")).select("*", winnowing.hash_of(F.col("e")).alias("h2"), winnowing.place_of(F.col("e")).alias("i2")).collect()
    assert all((r.h, r.i) == (r.h2, r.i2) for r in rows)
    assert [(r.h, r.i) for r in sorted(rows, key=lambda r: r.e)] == sorted(((r.h, r.i) for r in rows), key=lambda x: (x[0], -x[1]))


def brute_edited(rows, k, window):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for at, (i, t) in enumerate(order):
        after = order[(at + 1) % len(order)][1]
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        own, other, next_ = (brute_winnow(x, k, window) for x in (t, edited, after))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), as_text(own), as_text(other), brute_likeness(own, other), brute_likeness(own, next_)))
    return out


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_edited_texts(spark, monkeypatch, buckets):
    monkeypatch.setattr(winnowing, "buckets_of", lambda docs: buckets)
    rows = [(5, "one two three four five six seven"), (9, "été " * 40), (2, None), (2, ""), (None, "last of all words"), (None, "last of all but one"), (None, None), (70, "x"), (71, "long word " * 20_000)]
    rows += [(9, "été " * 40), (-4, "\U0001f600 " * 9), (-(1 << 63), "least id of all"), ((1 << 63) - 1, "w" * 300_000), *((33, f"equal ids {n}") for n in range(40))]
    frame = spark.createDataFrame([(i, t, 1, "c", "d", "e") for i, t in rows], "doc_id long, text string, n_chars int, edited string, fp string, next_text string").repartition(3)
    got = [tuple(r) for r in winnowing.compare_edited(frame, 3, 4).collect()]
    assert sorted(got, key=repr) == sorted(brute_edited(rows, 3, 4), key=repr)
    assert len({r[3] for r in got if r[0] == 9}) == 1  # equal texts, equal fingerprints
    assert winnowing.compare_edited(frame.limit(0)).count() == 0


def test_buckets_grow_with_rows(spark, monkeypatch):
    frame = spark.range(1000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    assert winnowing.buckets_of(frame) == 3
    monkeypatch.setattr(winnowing, "BUCKET_ROWS", 10)
    assert winnowing.buckets_of(frame) == 102
    labels = winnowing._labels(spark, 102)
    dealt = [r.p for r in spark.createDataFrame([(x,) for x in labels], "x int").select(F.pmod(F.hash("x"), F.lit(3)).alias("p")).collect()]
    assert len(set(labels)) == 102 and [dealt.count(p) for p in range(3)] == [34] * 3
    found = winnowing._bounds(frame, 100)
    assert 80 < len(found) <= 100 and found[0] == {"n": False, "d": -1000, "p": "393939"}


def test_short_near_copies_share_fingerprints(spark, tmp_path):
    from triagelake.llm.queries import op3_fingerprints

    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(rng.randint(11, 20)))) for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op3_fingerprints(spark, str(tmp_path)).collect()
    assert len(got) == 80 and all(r.near_edited > 0 and r.near_next == 0 for r in got)
    assert sorted(map(tuple, got)) == sorted(brute_edited(rows, 3, 4))


def test_training_segments_span_the_text():
    import pyarrow as pa

    def spread(n):
        words = ["".join(chr(97 + (i // 26**p) % 26) for p in range(3)) for i in range(n)]
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["en"]), pa.array([" ".join(words)])], ["doc_id", "lang", "text"])
        found = langid.segments(" ".join(words).encode())
        return found, next(langid._some_segments(iter([batch]), 64)).column(2)[0].as_py().split()

    for n in (10, 64, 65, 100, 127, 128, 191, 1000):
        found, got = spread(n)
        places = [found.index(x) for x in got]
        gaps = np.diff([*places, len(found)])
        assert len(got) == min(64, len(found)) and places[0] == 0 and gaps.max() <= -(-len(found) // 64)


def test_gradients():
    rng = np.random.default_rng(0)
    net = langid.Network.new(["a", "b", "c"], 5, 1, np.float64)
    x, y = rng.integers(0, 256, (6, 4)).astype(np.uint8), rng.integers(0, 3, 6)
    _, grads = net.loss_and_gradients(x, y)
    for w, g in zip(net.weights(), grads, strict=True):
        for _ in range(5):
            at = tuple(rng.integers(0, s) for s in w.shape)
            if w.shape[0] == 256:
                at = (x[rng.integers(0, 6), rng.integers(0, 4)], at[1])
            old = w[at]
            w[at] = old + 1e-5
            up, _ = net.loss_and_gradients(x, y)
            w[at] = old - 1e-5
            down, _ = net.loss_and_gradients(x, y)
            w[at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-7


def test_every_language_is_learnt(spark):
    """300 labels, one with most rows: each is a label of the network, with about as many documents as it may have."""
    rows = [(i, f"l{i % 300:03}" if i % 2 else "common", f"{chr(0x4E00 + i % 300) * 3} w{i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    net = langid.fit(docs, per_label=4, steps=2)
    assert set(net.labels) == {r[1] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2}
    clash = docs.limit(3).withColumnsRenamed({"lang": "_text", "doc_id": "TEXT_to_judge"})
    assert langid.identify(clash, net).columns == ["TEXT_to_judge", "_text", "text", "lang_pred", "score"] and langid.identify(clash, net).count() == 3


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.fit(docs)
    odd = [(1, None), (2, ""), (3, "123 %%% ..."), (4, "½ ²"), (5, "x" * 1_000_000), (None, "the and of that"), (6, "日本語")]
    frame = spark.createDataFrame([(i, t, "q", 1, True) for i, t in odd], "doc_id long, text string, lang_pred string, score int, held_out boolean")
    got = {r.doc_id: r for r in langid.identify(frame, net).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4 and got[5].lang_pred in net.labels and got[6].lang_pred in net.labels
    assert got[None].lang_pred == "en" and 0 <= got[None].score <= 1
    found = langid.identify(docs, net).where(langid.held_out(F.col("doc_id")))
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.93
    assert langid.fit(docs.limit(0)) is None
    assert langid.identify(frame, None).where("lang_pred <> 'und'").count() == 0
