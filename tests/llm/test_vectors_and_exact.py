"""Whitening, hard negatives and exact dedup against brute force, with nulls, ties, repeated rows and clashing columns."""

import collections
import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from alertweave.llm import exact_dedup, hard_negatives, registry, whitening

VECTORS = "vec_id long, embedding array<float>, label int, row string, x string, cell string, n string, anchor string"
EXTRA = ("r", "x", "c", "n", "a")


def made_vectors():
    r = random.Random(3)
    draw = lambda n=7: [r.uniform(-1, 1) for _ in range(n)]
    rows = [(i, draw(), r.randrange(4)) for i in range(1, 700)]
    rows += [(1000, [0.5] * 7, 1), (1100, [0.5] * 7, 1), *[(2000 + i, [0.5] * 7, i % 3) for i in range(40)]]  # ties
    rows += [(100, [0.25] * 7, 2), (100, [0.25] * 7, 2), (300, draw(), 9)]  # repeated rows, and an id with unlike rows
    rows += [(None, draw(), 1), (3000, None, 1), (3100, draw(), None), (3200, [None, *draw(6)], 1)]
    rows += [(3300, [math.nan, *draw(6)], 1), (3400, [math.inf, *draw(6)], 2), (3500, draw(3), 3), (3600, [], 2)]
    rows += [(700, [-1.0] * 7, 3), (800, [1.0] + [0.0] * 6, 77)]
    return rows


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(*row, *EXTRA) for row in made_vectors()], VECTORS).repartition(3)


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def brute_negatives(rows, every=100, keep=5):
    taken = [
        (i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(c))) for c in v])
        for i, v, label in rows
        if i is not None and label is not None and usable(v)
    ]
    out = []
    for k, (i, label, x) in enumerate(taken):
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(x, y)), j, other, m) for m, (j, other, y) in enumerate(taken)]
        scored.sort(key=lambda s: s[:2])
        for score, positive, _, _ in [s for s in scored if s[2] == label and s[3] != k][:keep]:
            window = [s for s in scored if s[2] != label and 80 * -score <= 100 * -s[0] <= 100 * -score]
            out += [(i, positive, n + 1, s[1], -score, -s[0]) for n, s in enumerate(window[:keep])]
    return out


@pytest.mark.parametrize("side_bytes", [hard_negatives.SIDE_BYTES, 4096])
def test_hard_negatives(vectors, side_bytes):
    # Small cells and blocks make many heaps merge.
    got = hard_negatives.hard_negatives(vectors, side_bytes=side_bytes)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(made_vectors())
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == sorted(want)


def test_hard_negatives_of_nothing(spark, vectors):
    assert hard_negatives.hard_negatives(vectors.limit(0)).count() == 0
    assert hard_negatives.hard_negatives(vectors.where("vec_id = 100")).count() == 0


def test_strassen_is_exact():
    r = np.random.default_rng(1)
    for m, k, n in [(1, 1, 1), (17, 33, 19), (70, 64, 129), (100, 41, 35), (33, 17, 64)]:
        a, b = r.integers(-(2**40), 2**40, (m, k)), r.integers(-1000, 1000, (k, n))
        assert (hard_negatives.strassen(a, b) == a @ b).all()
        assert (hard_negatives.strassen(a, b, leaf=2) == a @ b).all()


def test_heaps_merge_in_any_order():
    r = np.random.default_rng(2)
    scores, ids = r.integers(0, 9, (6, 400)), r.permutation(400)
    want = [sorted(zip(-s, ids))[:5] for s in scores]
    for _ in range(3):
        heaps, cuts = hard_negatives.Heaps(6, 5), np.split(r.permutation(400), [3, 50, 51, 300])
        for cut in cuts:
            heaps.add(np.arange(6), scores[:, cut], ids[cut])
        assert [list(zip(-s, i)) for s, i in zip(heaps.scores, heaps.ids)] == want


def test_large_scores_stay_exact(spark):
    rows = [(100, [2.0**22, 3.0], 1), (1, [2.0**22, 5.0], 1), (2, [2.0**22, 4.0], 2), (3, [1.0, 1.0], 2), (4, [1.0, 2.0], 3)]
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert sorted(map(tuple, got.collect())) == sorted(brute_negatives(rows))


def brute_whitening(rows, width):
    x = [[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] + [1000000] * (width - len(v)) for _, v, _ in rows if usable(v)]
    x = np.array(x)
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    return x, centred, values[::-1], vectors[:, ::-1]


def test_whitening(vectors):
    rows = [r for r in made_vectors() if usable(r[1])]
    x, centred, values, basis = brute_whitening(rows, 7)
    got = whitening.whiten(vectors, components=5).toPandas()
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(got) == 5 * len(rows) and set(got.n) == {len(rows)} and got.identity_error.nunique() == 1
    assert got.identity_error[0] < 1e-9
    deviation = (((len(rows) * x - x.sum(axis=0)) ** 2).sum(axis=1)).tolist()
    ids = [-1 if i is None else i for i, _, _ in rows]
    got["vec_id"] = got.vec_id.fillna(-1).astype(int)
    for k in range(5):
        part = got[got.component == k + 1]
        np.testing.assert_allclose(part.explained, values[k] / values.sum(), rtol=1e-9)
        assert collections.Counter(zip(part.vec_id, part.deviation)) == collections.Counter(zip(ids, deviation))
        want = centred @ basis[:, k] / np.sqrt(values[k])
        mine = sorted(zip(part.vec_id, part.deviation, part.whitened))
        sides = [sorted(zip(ids, deviation, sign * want)) for sign in (1, -1)]
        assert min(max(abs(a[2] - b[2]) for a, b in zip(mine, side)) for side in sides) < 1e-8


def test_whitening_of_degenerate_tables(spark, vectors):
    assert whitening.whiten(vectors.limit(0)).count() == 0
    assert whitening.whiten(vectors.where("vec_id = 3000")).count() == 0
    same = whitening.whiten(vectors.where("vec_id = 100 and label = 2")).toPandas()
    assert len(same) == 2 * 7 and same.whitened.isna().all() and set(same.explained) == {0.0}
    # Two dimensions that always agree have one component of variance between them.
    flat = spark.createDataFrame([(i, [float(i), float(i)]) for i in range(9)], "vec_id long, embedding array<double>")
    got = whitening.whiten(flat).toPandas()
    assert got[got.component == 2].whitened.isna().all() and got[got.component == 1].whitened.notna().all()
    np.testing.assert_allclose(got[got.component == 1].explained, 1.0)


def test_whitening_of_values_beyond_a_long(spark):
    rows = [(i, [1e300 * (-1) ** i, float(i)]) for i in range(10)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert len(got) == 20 and got.deviation.isna().all()
    np.testing.assert_allclose(got[got.component == 1].whitened.abs(), 1.0)


def test_whitening_of_large_values(spark):
    rows = [(i, [2.0**40 * i, float(i % 3)]) for i in range(10)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    exact = [sum((10 * v - s) ** 2 for v, s in zip((2**46 * i, 64 * (i % 3)), (2**46 * 45, 64 * 9))) for i in range(10)]
    want = [v if v < 2**63 else None for v in exact]
    mine = got[got.component == 1].sort_values("vec_id").deviation
    assert [None if math.isnan(v) else int(v) for v in mine.astype(float)] == [None if v is None else int(float(v)) for v in want]


@pytest.mark.parametrize("kind", ["random", "tied", "graded", "diagonal", "zero"])
def test_divide_and_conquer(kind):
    r = np.random.default_rng(4)
    q, _ = np.linalg.qr(r.standard_normal((12, 12)))
    values = {"tied": [5.0] * 4 + [1.0] * 5 + [0.0] * 3, "graded": list(np.logspace(3, -6, 12)), "zero": [0.0] * 12}.get(kind)
    a = np.diag(np.arange(12.0)) if kind == "diagonal" else q * (values or r.uniform(1, 9, 12)) @ q.T
    a = (a + a.T) / 2
    found, basis = whitening.eigen(a)
    scale = max(np.abs(a).max(), 1e-300)
    np.testing.assert_allclose(found, np.linalg.eigvalsh(a)[::-1], atol=1e-13 * scale)
    np.testing.assert_allclose(basis.T @ basis, np.eye(12), atol=1e-14)
    np.testing.assert_allclose(basis.T @ a @ basis, np.diag(found), atol=1e-13 * scale)


TEXT = "doc_id long, text string, lang string, recipe string, chunk string, row string, group_size long"


def made_texts():
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgamqy") for _ in range(r.randint(1, 8)))
    prose = lambda n: " ".join(word() + r.choice([",", "", "", ".", "\n"]) for _ in range(n))
    long = prose(30_000)
    texts = [prose(r.randint(1, 900)) for _ in range(20)] + [long, long, long[:90_000] + "!" + long[90_000:]]
    texts += ["x" * 30_000, "x" * 30_000, "日本語。" * 5000, "😀" * 9000, "", None, " ", "a", "a", "a ", "A", "é", "é"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, texts[3]), (3, "other"), (None, "a"), (None, None), (None, "z"), (None, "z")]
    return rows + [(500 + i, texts[7]) for i in range(40)]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t, "en", "r", "c", "w", 1) for i, t in made_texts()], TEXT).repartition(4)


def brute_copies(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = collections.Counter()
    for t, ids in groups.items():
        ids.sort(key=lambda i: -1 if i is None else i, reverse=True)
        for place, i in enumerate(ids):
            out[i, ids[0], len(ids), place == 0, hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


WEAK = lambda chunk: F.pmod(F.xxhash64(chunk), F.lit(3).cast("long"))


@pytest.mark.parametrize(
    "options",
    [{}, {"least": 8, "most": 40}, {"identifiers": (WEAK, exact_dedup.IDENTIFIERS[0], exact_dedup.IDENTIFIERS[-1])}, {"identifiers": (WEAK, exact_dedup.IDENTIFIERS[-1])}],
)
def test_exact_dedup(texts, options):
    got = exact_dedup.copies(texts, **options)
    assert got.columns[:5] == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert collections.Counter(map(tuple, got.drop("n_chunks").collect())) == brute_copies(made_texts())


def test_exact_dedup_keeps_rows_unchanged(texts):
    left = exact_dedup.deduplicated(texts)
    assert left.schema == texts.schema
    want = collections.Counter((i, t) for i, t in {(k[0], k[4]) for k in brute_copies(made_texts()) if k[3]})
    got = collections.Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in left.collect())
    assert got == want
    assert exact_dedup.deduplicated(texts.limit(0)).count() == 0 and exact_dedup.copies(texts.limit(0)).count() == 0


def test_chunks_follow_the_content(spark, texts):
    found = texts.where("text is not null").select("text", exact_dedup.chunks(F.col("text")).alias("chunks")).collect()
    assert all("".join(r["chunks"]) == r["text"] for r in found)
    assert max(len(c) for r in found for c in r["chunks"]) <= exact_dedup.MOST
    long = [set(r["chunks"]) for r in found if len(r["text"]) > 100_000]
    # One more character in the middle of a long text leaves nearly all chunks as they are.
    assert len(long) == 3 and len(set.intersection(*long)) > 0.9 * len(long[0])


def test_verification_finds_identifiers_with_two_contents(texts):
    plain = texts.select(exact_dedup.whole(F.col("text")).alias("text"))
    assert exact_dedup.unverified(plain, exact_dedup.IDENTIFIERS[0]).isEmpty()
    assert not exact_dedup.unverified(plain, WEAK).isEmpty()


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_queries_equal_their_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    cursor = con.execute(registry.ORACLE[name])
    columns = sorted(d[0] for d in cursor.description)
    want = collections.Counter(cursor.df()[columns].itertuples(index=False, name=None))
    got = registry.QUERIES[name](spark, folder).select(*columns).toPandas()
    assert collections.Counter(got.itertuples(index=False, name=None)) == want
