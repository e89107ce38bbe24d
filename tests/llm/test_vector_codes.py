"""Vector codes against plain Lloyd rounds in Python's integers."""

import hashlib
import math

import duckdb
import numpy as np

from triagelake.llm import vector_codes
from triagelake.llm.queries import oracle_sql, queries

SMALL = "/root/testdata/sf0.001"


def units(x):
    return max(-(1 << 63), min((1 << 63) - 1, math.floor(1024 * x))) if math.isfinite(1024 * x) else (1 << 63) - 1 if x > 0 else -(1 << 63)


def brute(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error, label_error, digest) of rows (vec_id, vector, label)."""
    kept = [(i, [units(x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    sizes = [len(v) for _, v, _ in kept if len(v) % parts == 0]
    width = max(set(sizes), key=lambda n: (sizes.count(n), n), default=0)
    kept = [r for r in kept if len(r[1]) == width]
    w = width // parts
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(parts)]
    starts = {}
    for i, v, _ in kept:
        if i is not None:
            starts[i] = min(starts.get(i, v), v)
    if not starts:
        return []
    books = [list(x) for x in zip(*(cut(starts[i]) for i in sorted(starts)[:entries]), strict=True)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, x: min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, v, _ in kept:
                x = cut(v)[p]
                members.setdefault(near(p, x), []).append(x)
            for e, some in members.items():
                books[p][e] = [sum(c) // len(some) for c in zip(*some, strict=True)]
    out = []
    for i, v, label in kept:
        codes = [near(p, x) for p, x in enumerate(cut(v))]
        error = sum(far(x, books[p][e]) for p, (x, e) in enumerate(zip(cut(v), codes, strict=True)))
        out.append((i, bytes(codes).hex(), min(error, (1 << 63) - 1), label))
    total = {}
    for r in out:
        total[r[3]] = total.get(r[3], 0) + r[2]
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return [(i, code, error, min(total[label], (1 << 63) - 1), digest) for i, code, error, label in out]


DDL = "vec_id long, embedding array<double>, label int, code string, what int"


def check(spark, rows, **kw):
    frame = spark.createDataFrame([(i, v, label, "clash", None) for i, v, label in rows], DDL).repartition(4)
    got = vector_codes.compress(frame, **kw)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows, **kw), key=str)


def test_by_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, 8)], int(i) % 3 if i % 5 else None) for i in rng.permutation(140)]
    check(spark, rows, entries=12)
    check(spark, rows, entries=256)  # more entries than vectors
    check(spark, rows, entries=5, parts=2, rounds=7)


def test_ties_repeats_nulls_and_odd_lengths(spark):
    rng = np.random.default_rng(12)
    whole = [(i, [float(x) / 1024 for x in rng.integers(-2, 3, 8)], 1) for i in range(120)]  # many equal distances
    odd = [
        (None, [0.1] * 8, 2), (3, [0.5] * 8, 1), (3, [0.5] * 8, 1), (3, [-0.5] * 8, None), (200, None, 1), (201, [], 1), (202, [math.nan] + [0.0] * 7, 1), (203, [math.inf] + [0.0] * 7, 1),
        (204, [None] + [0.0] * 7, 1), (205, [0.0] * 7, 1), (206, [0.0] * 12, 1), (-5, [0.25, -0.25] * 4, 9),
    ]
    check(spark, whole + odd, entries=9)
    check(spark, [(None, [1.0] * 4, 1)])
    check(spark, [(1, None, 1)])
    frame = spark.createDataFrame([], DDL)
    assert vector_codes.compress(frame).count() == 0


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(13)
    rows = [(i, [float(x) for x in rng.normal(0, 10.0 ** (i % 9), 8)], i % 2) for i in range(60)]
    rows += [(100, [1e300] * 8, 0), (101, [-1e300] * 8, 0), (102, [9e15] * 8, 1), (103, [9.1e15] * 8, 1)]
    check(spark, rows, entries=20)


def test_only_changes_contribute():
    """Once assignments settle a round contributes nothing; the running sums equal sums counted anew."""
    rng = np.random.default_rng(14)
    vectors = rng.integers(-500, 500, (300, 8))
    books = vector_codes.Codebooks(vectors[:10].reshape(10, 4, 2).transpose(1, 0, 2).copy())
    import pyarrow as pa

    def one(codes, first):
        columns = {"vec_id": pa.array(range(300), pa.int64()), "label": pa.nulls(300, pa.string()), "vector": pa.array(vectors.tolist(), vector_codes.VECTOR), "codes": pa.array(codes, pa.binary())}
        rows, deltas = vector_codes._round(iter([pa.RecordBatch.from_pydict(columns)]), books, first)
        return rows.column("codes").to_pylist(), deltas

    codes, deltas = one([None] * 300, True)
    assert sum(deltas.column("n").to_pylist()) == 4 * 300
    again, none = one(codes, False)
    assert again == codes and none.num_rows == 0
    moved = [bytes([c[0] ^ (i == 7), *c[1:]]) for i, c in enumerate(codes)]
    _, two = one(moved, False)
    assert sorted(two.column("n").to_pylist()) == [-1, 1]


def test_many_labels_are_joined_with_salts(spark):
    coded = spark.createDataFrame([(i, str(i % 7) if i % 5 else None, "00", i * i) for i in range(200)], "vec_id long, label string, code string, error long")
    few = sorted(map(tuple, vector_codes.with_label_error(coded).collect()), key=str)
    assert few == sorted(map(tuple, vector_codes.with_label_error(coded, labels=2, salts=5).select(*coded.columns, "label_error").collect()), key=str)
    assert len(few) == 200


def test_query_by_sql_and_brute_force(spark, tmp_path):
    base = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in base.collect()]
    got = sorted(map(tuple, queries()["op11_vector_codes"](spark, SMALL).collect()))
    assert got == sorted(brute(rows))
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{SMALL}/embeddings.parquet'")
    assert got == sorted(db.execute(oracle_sql()["op11_vector_codes"]).fetchall())
