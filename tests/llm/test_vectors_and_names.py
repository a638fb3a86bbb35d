"""Exact dedup by names, whitening and vector codes against brute force, on the smallest tables and on awkward rows."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, vector_codes, vectors, whitening

BLANK = re.compile("[\x20\x09-\x0d]+")


def texts(spark):
    """Nulls, empty and blank texts, copies up to blanks, repeated and missing ids, block borders, texts that share all blocks but one."""
    long = "".join(random.Random(3).choices("ab \n", k=700))
    rows = [
        (5, None), (4, ""), (6, " \t\n"), (7, " "), (8, "a b"), (3, "a\t\n b"), (3, "a b"), (None, "a  b"), (None, "only without id"), (None, "only without id"), (9, "é ß 漢字\u0085 x"), (10, "é ß 漢字\u0085 x"), (11, "a b "), (12, " a b"),
        (20, long), (21, long), (22, long[:-1] + "c"), (23, "c" + long[1:]), (24, long + "x"), (25, long[:64]), (26, long[:128]), (27, long[:64]), (28, long * 40), (29, long * 40), (30, long * 40 + "y"), (20, long),
    ]
    return spark.createDataFrame([(i, t, "x", "clash", 1) for i, t in rows], "doc_id long, text string, name string, h string, level int")


def groups_of(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[BLANK.sub(" ", t or "")].append(i)
    out = []
    for t, ids in by.items():
        known = [i for i in ids if i is not None]
        keep, digest = min(known) if known else None, hashlib.sha256(t.encode()).hexdigest()
        kept = ids.index(keep)
        out += [(i, keep, len(ids), k == kept, digest) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("block", "bits"), [(64, 64), (4096, 64), (64, 3), (16, 0)])
def test_exact_duplicates(spark, block, bits):
    df = texts(spark)
    assert rows_of(exact_dedup.duplicate_report(df, block, bits)) == groups_of([(r["doc_id"], r["text"]) for r in df.collect()])


def test_exact_duplicates_when_shared_hashes_are_too_many_to_list(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LISTED", 2)
    df = texts(spark)
    assert rows_of(exact_dedup.duplicate_report(df, 64, 4)) == groups_of([(r["doc_id"], r["text"]) for r in df.collect()])


def test_exact_duplicates_of_a_table_and_of_none(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows_of(exact_dedup.duplicate_report(df)) == groups_of([(r["doc_id"], r["text"]) for r in df.collect()])
    assert exact_dedup.duplicate_report(df.where("false")).count() == 0


def test_drop_exact_duplicates_keeps_whole_rows(spark):
    df = texts(spark)
    left = exact_dedup.drop_exact_duplicates(df, 64)
    assert left.schema == df.schema
    norm = lambda rows: sorted(BLANK.sub(" ", r["text"] or "") for r in rows)
    assert norm(left.collect()) == sorted({BLANK.sub(" ", r["text"] or "") for r in df.collect()})
    assert {3, 4, 9, 20, 28} <= {r["doc_id"] for r in left.collect()}


def test_a_third_of_all_rows_are_one_text(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.repeat(F.lit("hot text "), 30)).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    out = exact_dedup.duplicate_report(df, 64)
    assert out.where("kept").count() == 2001 and [tuple(r) for r in out.where("group_size > 1").select("keep_id", "group_size").distinct().collect()] == [(0, 1000)]


VECTORS = "vec_id long, embedding array<float>, label int, x string, n string"


def awkward_vectors(spark, n=300, width=32, seed=1):
    dice = np.random.default_rng(seed)
    rows = [(int(i) * 3, [float(v) for v in dice.standard_normal(width) / 8 + (i % 5)], None if i % 7 == 0 else int(i % 3), "a", "b") for i in dice.permutation(n)]
    rows += [(r[0] + 1, r[1], r[2], "a", "b") for r in rows[: n // 3]]  # repeated vectors
    rows += [rows[0], (rows[1][0], [0.5] * width, 1, "a", "b"), (None, [0.25] * width, 2, "a", "b"), (None, [-0.001] * width, None, "a", "b")]
    rows += [(1_000, None, 1, "a", "b"), (1_001, [0.1] * (width - 1) + [None], 1, "a", "b"), (1_002, [float("nan")] * width, 1, "a", "b"), (1_003, [float("inf")] + [0.0] * (width - 1), 1, "a", "b"), (1_004, [], 1, "a", "b"), (1_005, [1.0], 1, "a", "b")]
    return spark.createDataFrame(rows, VECTORS)


def kept_rows(df, width):
    out = []
    for r in df.collect():
        v = r["embedding"]
        if v is not None and len(v) == width and all(c is not None and np.isfinite(c) for c in v):
            out.append((r["vec_id"], r["label"], [int(np.floor(256 * float(c))) for c in v]))
    return sorted(out, key=lambda t: (t[0] is None, t[0] or 0, t[2]))


def codes_by_brute_force(rows, width, entries=64):
    d = width // 16
    x = np.array([r[2] for r in rows], np.int64).reshape(len(rows), 16, d)
    books = x[:entries].transpose(1, 0, 2).copy()
    assign = lambda: ((x[:, :, None] - books[None]) ** 2).sum(3).argmin(2)
    for _ in range(2):
        near = assign()
        for p in range(16):
            for e in range(books.shape[1]):
                mine = x[near[:, p] == e, p]
                if len(mine):
                    books[p, e] = [sum(map(int, mine[:, j])) // len(mine) for j in range(d)]
    near = assign()
    error = ((x - books[np.arange(16)[None], near]) ** 2).sum((1, 2))
    by = defaultdict(int)
    for r, e in zip(rows, error, strict=True):
        by[r[1]] += int(e)
    digest = hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()
    return sorted(((r[0], bytes(n.astype(np.uint8)).hex(), int(e), by[r[1]], digest) for r, n, e in zip(rows, near, error, strict=True)), key=repr)


def test_vector_codes(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert rows_of(vector_codes.code_report(df)) == codes_by_brute_force(kept_rows(df, 64), 64)


@pytest.mark.parametrize("n", [5, 300])
def test_vector_codes_of_awkward_rows(spark, n):
    df = awkward_vectors(spark, n)
    assert rows_of(vector_codes.code_report(df)) == codes_by_brute_force(kept_rows(df, 32), 32)


def test_vector_codes_of_other_widths_and_of_none(spark):
    rows = [(i, [float(i % 7)] * 18, i % 2) for i in range(100)]
    out = vector_codes.code_report(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(out) == 100 and all(r["error"] == 0 and len(r["code"]) == 32 for r in out)
    assert vector_codes.code_report(spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_filtering_agrees_with_all_distances(seed):
    dice = np.random.default_rng(seed)
    n, d, k = int(dice.integers(1, 3000)), int(dice.integers(1, 5)), int(dice.integers(1, 65))
    points, book = dice.integers(-9, 9, (n, d)), dice.integers(-9, 9, (k, d))  # many ties and repeated entries
    tree = vector_codes.plant(points)
    want = ((points[:, None] - book[None]) ** 2).sum(2).argmin(1)
    assert (vector_codes.nearest(points, tree, book) == want).all()
    sums = np.array([[(want == e).sum(), *points[want == e].sum(0)] for e in range(k)])
    assert (vector_codes.tally(points, tree, book) == sums).all()


def test_filtering_assigns_whole_subtrees():
    points = np.random.default_rng(0).integers(-1000, 1000, (8192, 2))
    settled, (left, _) = vector_codes.walk(points, vector_codes.plant(points), points[:16])
    assert len(left) < len(points) / 2 and any(len(nodes) for level, nodes, _ in settled if level < 6)


def test_decoded_vectors_are_as_far_as_the_error_says(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    coded, books = vector_codes.vector_codes(df)
    near = {r["vec_id"]: r for r in vector_codes.decode(coded, books, 64).collect()}
    for i, _, x in kept_rows(df, 64):
        assert ((np.array(near[i]["approximate"]) * 256 - x) ** 2).sum() == near[i]["error"]


def whitening_by_brute_force(rows, k=4):
    x = np.array([r[2] for r in rows], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    e, v = np.linalg.eigh(np.cov(fit.T, bias=True))
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return n, {tuple(a): int(((n * a.astype(object) - s) ** 2).sum()) for a in x}, (x - s / n) @ v / np.sqrt(e), e / np.cov(fit.T, bias=True).trace()


def check_whitening(df, width):
    rows = kept_rows(df, width)
    n, deviation, white, share = whitening_by_brute_force(rows)
    found = defaultdict(list)
    for r in whitening.whitening_report(df).collect():
        found[r["vec_id"], r["deviation"]].append(r)
    assert sum(map(len, found.values())) == 4 * len(rows)
    sign = np.zeros(4)
    for (i, _, x), w in zip(rows, white, strict=True):
        for r in found[i, deviation[tuple(x)]]:
            c = r["component"] - 1
            assert r["n"] == n and abs(r["explained"] / share[c] - 1) < 1e-9 and r["identity_error"] < 1e-9
            if not sign[c] and abs(w[c]) > 0.1:
                sign[c] = np.sign(w[c] * r["whitened"])
            assert abs(r["whitened"] * (sign[c] or 1) - w[c]) < 1e-8 or not sign[c]


def test_whitening(spark, sf):
    check_whitening(spark.read.parquet(f"{sf}/embeddings.parquet"), 64)


def test_whitening_of_awkward_rows(spark):
    check_whitening(awkward_vectors(spark), 32)


def test_whitening_converges_in_few_passes_where_a_gap_is(spark):
    dice = np.random.default_rng(5)
    x = dice.standard_normal((2000, 200)) * np.array([40, 30, 20, 10, *[0.2] * 196])
    df = spark.createDataFrame([(i, [float(c) for c in r], 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    fit = whitening.fit_list(df)
    w = whitening.fit(fit, 200)
    assert w.passes < 12 and w.residual <= whitening.TOLERANCE * w.values[0]
    e = np.linalg.eigvalsh(np.cov(np.floor(x * 256).T, bias=True))[::-1][:4]
    assert np.allclose(w.values, e, rtol=1e-12)


def test_whitening_without_variance_and_of_other_columns(spark):
    schema = "vec_id long, embedding array<double>, label int, _white string"
    assert whitening.whitening_report(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitening_report(spark.createDataFrame([(1, [1.0, 2.0], 1, ""), (2, [1.0, 2.0], 1, "")], schema)).count() == 0
    two = spark.createDataFrame([(1, [1.0, 2.0], 1, "c"), (2, [1.0, 3.0], 1, "c"), (3, [1.0, 3.0], 1, "c")], schema)
    assert sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 9), r["n"]) for r in whitening.whitening_report(two).collect()) == [(1, 1, 1.0, 2), (2, 1, 1.0, 2), (3, 1, 1.0, 2)]
    assert sorted((r["vec_id"], [round(abs(c), 9) for c in r["_white"]]) for r in whitening.whiten(two).collect()) == [(1, [1.0]), (2, [1.0]), (3, [1.0])]
    assert [r["_white"] for r in whitening.whiten(two.where("vec_id = 1")).collect()] == [[]]


def test_deviation_beyond_a_long_is_null():
    w = whitening.Whitening(3, [0, 0], 1.0, np.ones(1), np.ones((2, 1)), 0.0, 1)
    assert whitening._deviation(np.array([[1 << 40, 0], [5, -1]]), w) == [None, 234]


def test_components_are_scaled_down_and_saturated():
    assert vectors.scaled([-0.001, 0.0, 1.999 / 256, 1e30], 1 << 24).tolist() == [-1, 0, 1, 1 << 24]
