"""The pipeline and its stages against plain versions of them, over documents with planted copies, lines and passages."""

import collections
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_dedup_ops import brute_windows, components, shingles
from tokenizers import Tokenizer

from triagelake.llm import langid, line_dedup
from triagelake.llm.common import materialize

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SMALL = "/root/testdata/sf0.001"
SPACE = " \t\n\v\f\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def scalar_probabilities(net, segment):
    """The sum over positions of a segment's label probabilities, one number at a time."""
    sigmoid = lambda x: 1 / (1 + math.exp(-x))

    def states(direction, data):
        width = direction.state.shape[0]
        h, out = [0.0] * width, []
        for byte in data:
            seen = direction.table[byte].tolist()
            own = [sum(h[i] * float(direction.state[i, j]) for i in range(width)) for j in range(3 * width)]
            z = [sigmoid(seen[j] + own[j]) for j in range(width)]
            r = [sigmoid(seen[width + j] + own[width + j]) for j in range(width)]
            n = [math.tanh(seen[2 * width + j] + r[j] * own[2 * width + j]) for j in range(width)]
            h = [(1 - z[j]) * n[j] + z[j] * h[j] for j in range(width)]
            out.append(h)
        return out

    ahead, behind = states(net.ahead, segment), states(net.behind, segment[::-1])[::-1]
    total = [0.0] * len(net.labels)
    for a, b in zip(ahead, behind, strict=True):
        logits = [sum(x * float(net.out[i, k]) for i, x in enumerate(a + b)) + float(net.bias[k]) for k in range(len(net.labels))]
        e = [math.exp(x - max(logits)) for x in logits]
        total = [t + x / sum(e) for t, x in zip(total, e, strict=True)]
    return total


def scalar_language(net, text, memo):
    """(label, score) of a text by the definition."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    total = np.zeros(len(net.labels))
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    for run in re.findall(rb"[a-z\x80-\xff]+", lower):
        for at in range(0, len(run), 32):
            part = run[at : at + 32]
            if part not in memo:
                memo[part] = np.array(scalar_probabilities(net, part))
            total += memo[part]
    return net.labels[int(total.argmax())], float(total.max() / total.sum())


def plain_lines(rows, edits=2, least=32):
    """(doc_id, text) after line dedup: long lines alike by edits, short ones by fewer in proportion."""
    seen = [(i, k, x.strip(SPACE)) for i, t in rows if i is not None for k, x in enumerate((t or "").split("\n")) if x.strip(SPACE)]
    kinds = sorted({x for _, _, x in seen})
    alike = lambda x, y: line_dedup.within(x, y, min(edits, min(len(x), len(y)) * edits // least))
    low = components(list(enumerate(kinds)), alike)
    number = {x: k for k, x in enumerate(kinds)}
    first = {}
    for i, k, x in seen:
        first[low[number[x]]] = min(first.get(low[number[x]], (i, k)), (i, k))
    out = []
    for i, t in rows:
        raw = (t or "").split("\n")
        kept = [x for k, x in enumerate(raw) if i is None or not x.strip(SPACE) or first[low[number[x.strip(SPACE)]]] >= (i, k)]
        if len(kept) == len(raw):
            out.append((i, t))
        elif "\n".join(kept).strip(SPACE):
            out.append((i, "\n".join(kept)))
    return out


def plain_copies(rows):
    sets = {t: shingles(t) for _, t in rows}
    low = components(rows, lambda x, y: bool(sets[x]) and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]))
    return [(i, t) for i, t in rows if i is None or low[i] == i]


def plain_repeats(rows, size=13):
    word = re.compile(rf"[^{SPACE}]+[{SPACE}]*")
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        found = (t or "").split()
        for j in range(len(found) - size + 1):
            first.setdefault(tuple(found[j : j + size]), i)
    out = []
    for i, t in rows:
        found = [w.rstrip(SPACE) for w in word.findall(t or "")]
        gone = {j + k for j in range(len(found) - size + 1) if i is not None and first[tuple(found[j : j + size])] < i for k in range(size)}
        if not gone:
            out.append((i, t))
        elif len(gone) < len(found):
            out.append((i, "".join(w for j, w in enumerate(word.findall(t)) if j not in gone).rstrip(SPACE)))
    return out


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Documents with what each stage looks for, and odd ones."""
    rng = random.Random(11)
    given = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) between 100 and 1500").orderBy("doc_id").limit(110).collect()
    rows = [[10 * k, r.text, r.lang, r.source] for k, r in enumerate(given)]
    line, short = "This very line stands in many of the documents here", "All rights reserved."
    passage = " ".join(rng.choice("the and that with have this will from they would there which".split()) + str(rng.randrange(500)) for _ in range(60))
    for k in range(0, 60, 3):
        rows[k][1] += f"\n{line if k % 2 else line.replace('many', 'mamy')}\n  {short}\n"
    for k in range(60, 75):
        words = rows[k][1].split(" ")
        rows[k][1] = " ".join([*words[: k % 7], passage, *words[k % 7 :]])
    for k in range(75, 90):  # copies and near copies of the one before
        rows[k][1] = rows[k - 75][1].replace("\n", " ") if k % 2 else " ".join(w if j != 5 else "changed" for j, w in enumerate(rows[k - 75][1].split()))
    odd = [(None, "no id but words of the text that and this"), (None, None), (2001, None), (2002, ""), (2003, " \n\t"), (2004, "12345 %%%"), (2005, "Ünï cödé " * 3), (2006, "word and the " * 30_000), (2007, "w" * 400_000)]
    rows += [[i, t, None, "x"] for i, t in odd] + [list(rows[3]), list(rows[90])]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA).repartition(5)
    out = str(tmp_path_factory.mktemp("planted"))
    docs.write.parquet(f"{out}/documents.parquet")
    return out


def kept(frame):
    return collections.Counter((r.doc_id, r.text) for r in frame.collect())


def test_stages_and_run_by_plain_versions(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "lines", "near_copies", "substrings", "packing"]
    net, memo = langid.fit(docs), {}
    found = {t: scalar_language(net, t, memo) for t in {r.text for r in docs.collect()}}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    scored = {r.text: (r.lang_pred, r.score) for r in langid.identify(docs, net).collect()}
    assert all(scored[t][0] == lang and abs(scored[t][1] - s) < 1e-4 for t, (lang, s) in found.items())
    rows = [(i, t) for i, t in rows if found[t][0] != "und" and found[t][1] >= corpus_pipeline.LEAST_SCORE]
    assert {2001, 2002, 2003, 2004}.isdisjoint(i for i, _ in rows) and len(rows) > 80
    for name, plain in (("language", None), ("lines", plain_lines), ("near_copies", plain_copies), ("substrings", plain_repeats)):
        before = len(rows)
        rows = plain(rows) if plain else rows
        docs = materialize(stages[name](spark, docs, planted), f"test-{name}")
        assert docs.columns == corpus_pipeline.COLUMNS and kept(docs) == collections.Counter(rows), name
        assert docs.where("n_chars <> length(text)").count() == 0
        assert name == "language" or len(rows) < before or name in ("lines", "substrings")
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.WORD_VOCABULARY))
    wanted = collections.Counter((i, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) for i, t in rows)
    for packed in (stages["packing"](spark, docs, planted), corpus_pipeline.run(spark, planted)):
        pieces = packed.collect()
        assert collections.Counter((r.doc_id, r.doc_tokens) for r in pieces if r.start == 0) == wanted
        assert sum(r.length for r in pieces) == sum(n * k for (_, n), k in wanted.items())
        sequences = collections.defaultdict(list)
        for r in pieces:
            sequences[r.sequence_id].append((r.offset, r.length))
        assert all([o for o, _ in sorted(v)] == np.cumsum([0] + [n for _, n in sorted(v)])[:-1].tolist() and sum(n for _, n in v) <= 2048 for v in sequences.values())


def test_plain_versions_agree_with_the_digests():
    rows = [(1, "a b c d e f g h i j k l m n"), (2, "x a b c d e f g h i j k l m y"), (None, "a b c d e f g h i j k l m n")]
    assert [len((t or "").split()) for _, t in plain_repeats(rows)] == [n - gone for (_, n, gone, _), _ in sorted(brute_windows(rows).items(), key=lambda r: (r[0][0] is None, r[0][0] or 0))]


ODD_ROWS = [(None, None, None, None, None), (1, None, "en", "a", 0), (1, None, "en", "a", 0), (2, "", None, None, 0), (3, "same words", "en", "b", 10), (4, "same words", "en", "b", 10)]


@pytest.mark.parametrize("rows", [[], ODD_ROWS])
def test_stages_on_odd_tables(spark, rows):
    """Empty tables, nulls in every column, empty texts, repeated rows: no stage fails, each returns the columns of documents."""
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("component_id", F.lit("clash"))
    texts = {name: kept(stage(spark, docs, "")) for name, stage in corpus_pipeline.STAGES[:-1]}
    given = collections.Counter((i, t) for i, t, *_ in rows)
    once = given - collections.Counter([(4, "same words")])
    assert texts == {"language": collections.Counter({k: n for k, n in given.items() if k[1]}), "lines": once, "near_copies": once, "substrings": given}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == len(rows)
