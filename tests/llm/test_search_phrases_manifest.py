"""Exact search, collocations and the manifest against plain versions and their SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import collocations, exact_topk, merkle, queries
from tests.compare import difference, duck
from tests.llm import brute

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
NEW = sorted(queries.ORACLES)


def key(row):
    return tuple((x is not None, x) for x in row)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=key)


@pytest.mark.parametrize("name", NEW)
def test_queries_equal_their_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF), duck(SF), queries.ORACLES[name]) is None


def search(spark, rows, every=50, k=5, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, no int, bucket int, v string")
    return rows_of(exact_topk.search(df.repartition(3), every, k))


def vectors(rows):
    return [(i, v, 1, 2, "x") for i, v in rows]


def test_search_equals_all_pairs_on_awkward_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.3, 24).tolist()) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 430)]  # copies tie: smaller ids first
    rows += [(500, None), (501, [0.1, None]), (502, [float("nan"), 1.0]), (503, [float("inf")]), (504, [1e308] * 3),
             (550, []), (505, []), (None, rows[3][1]), (None, None), (600, [0.5] * 40), (601, [-0.5] * 3),
             (50, rows[50][1]), (650, [0.0, -1e-9, 1.0]), (7, rows[7][1])]
    assert search(spark, vectors(rows)) == sorted(brute.top_k(rows), key=key)


def test_search_in_whole_numbers_beyond_floats(spark):
    big = [(i, [2.0**i, 3.0, -(2.0**(45 - i))]) for i in range(0, 46)] + [(50, [2.0**60, 1.0, 1.0]), (100, [1e300] * 2)]
    assert search(spark, vectors(big), 10, 7) == sorted(brute.top_k(big, 10, 7), key=key)


def test_search_of_few_and_no_rows(spark):
    assert search(spark, vectors([(0, [1.0])])) == []
    assert search(spark, vectors([(0, [1.0]), (1, [2.0])])) == [(0, 1, 1, 131072)]
    assert search(spark, []) == []


def test_planes_drop_candidates_but_no_answer():
    rng = np.random.default_rng(2)
    values = rng.integers(-60, 60, (3000, 64)).astype(float)
    values[:20] += values[100] * 3
    plane = exact_topk.Plane(np.arange(3000), np.zeros(3000, bool), np.full(3000, 64), values.ravel())
    score = values @ values[100]
    places, found = plane.search(values[100], 100, 5, -np.inf)
    best = np.lexsort((np.arange(3000), -np.where(np.arange(3000) == 100, -np.inf, score)))[:5]
    assert set(best) <= set(places) and len(places) < 300
    assert (found == score[places]).all()


def docs_of(spark, rows):
    """rows: lang, text; columns that the operator names itself clash."""
    return spark.createDataFrame(
        [(i, t, lang, "s", 1, "x", 1) for i, (lang, t) in enumerate(rows)], DOCS + ", phrase string, h int").repartition(3)


def spoken(seed, n, size=40):
    rng = np.random.default_rng(seed)
    words = ["Ab", "cd", "é", "fgh", "The", "x.y", "a,b", "zz;", "q\n", "r\t", "no\u00a0gap"] + [f"w{i}" for i in range(12)]
    return [(["en", "de", None, "und", ""][i % 5], " ".join(rng.choice(words, size))) for i in range(n)]


@pytest.mark.parametrize("sample", [1, 8, 1 << 40])
def test_collocations_do_not_depend_on_the_sample(spark, monkeypatch, sample):
    monkeypatch.setattr(collocations, "SAMPLE", sample)
    rows = spoken(3, 200) + [("en", None), ("en", ""), (None, " . ;"), ("xx", "a b")] + [("de", "der die das. der die")] * 60
    got = rows_of(collocations.collocations(docs_of(spark, rows), least=8))
    assert got == sorted(brute.collocations(rows, least=8), key=key)
    assert len(got) > 100


def test_collocations_with_full_bit_sets_and_a_rank_limit(spark, monkeypatch):
    monkeypatch.setattr(collocations, "_size", lambda n: 1 << 6)  # nearly every phrase seems proposed
    rows = spoken(4, 60)
    assert rows_of(collocations.collocations(docs_of(spark, rows), 5, 7)) == sorted(
        brute.collocations(rows, 5, 7), key=key)


def test_collocations_of_long_texts_and_of_none(spark):
    rng = np.random.default_rng(5)
    long = " ".join(rng.choice([f"word{i}" for i in range(30)], 800_000))  # no place to cut a piece
    rows = [("en", long), ("en", "y" * 5_000_000), ("en", "\t" * 4_500_000 + "end")]
    df = docs_of(spark, rows)
    f, n = brute.phrase_counts(rows)
    got = {(r.lang, tuple(r.phrase.encode().split(b" "))): r.n for r in
           collocations.frequent_phrases(df, 700).filter("k > 0").collect()}
    assert got == {x: c for x, c in f.items() if c >= 700}
    assert collocations.frequent_phrases(df, 700).filter("k = 0").first().n == n["en"]
    assert rows_of(collocations.collocations(df.limit(0))) == []
    assert rows_of(collocations.collocations(docs_of(spark, [("en", "a b c")]))) == []


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3 * 10**12 + 7
    rows = [("l", 0, "", 10**15 + 1), ("l", 1, "a", big + 5), ("l", 1, "b", big + 11), ("l", 2, "a b", big)]
    got = collocations.scored(spark.createDataFrame(rows, "lang string, k int, phrase string, n long")).first()
    assert got.score == 1000 * big * (10**15 + 1) // ((big + 5) * (big + 11))


def crc_fifth():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def manifest_rows():
    rng = np.random.default_rng(6)
    rows = [(i, ["a", "b", None, "é", ""][int(rng.integers(0, 5)) % (1 + i % 5)], "en", i, f"Text {i} É") for i in range(900)]
    rows += [(5, "a", "en", 1, "again"), (5, "a", "en", 1, "again"), (None, "a", None, None, None), (None, None, None, None, ""),
             (None, "lone", "l", 0, "X" * 3_000_000), (2000, "one more", None, -5, None)]
    return rows + [(i, f"s{i}", "en", 1, "Own source") for i in range(3000, 3300)]


def test_manifest_equals_a_plain_tree(spark):
    rows = manifest_rows()
    df = spark.createDataFrame(
        [(d, t, lang, s, n, 1, "h") for d, s, lang, n, t in rows], DOCS + ", tree int, hash string").repartition(5)
    got = rows_of(merkle.manifest(df, crc_fifth()))
    assert got == sorted(brute.merkle(rows), key=key)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 16, 17, 257])
def test_manifest_of_small_trees(spark, n):
    rows = [(i, "s", "en", 1, f"T{i}") for i in range(n)]
    df = spark.createDataFrame([(d, t, lang, s, c) for d, s, lang, c, t in rows], DOCS)
    assert rows_of(merkle.manifest(df, crc_fifth())) == sorted(brute.merkle(rows), key=key)
