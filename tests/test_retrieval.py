"""Ranking over a whole corpus: against brute force, and without pairs in shuffles."""

import math
import random
import time
from collections import Counter

import pytest

from corvane.operators import retrieval


def texts(n, seed):
    """Texts of common words and some rare ones, a few of them blank and many alike."""
    r = random.Random(seed)
    return [" ".join(["the"] * r.randint(0, 2) + [f"w{int(r.paretovariate(0.7)) % 60}" for _ in range(r.choice([0, 2, 2, 4, 7]))]) for _ in range(n)]


def expected(docs, asked, k, exclude_self):
    """docs: (id, text), an id may repeat; for each query its k best as (id, score)."""
    rows = [(i, Counter(t.split())) for i, t in docs]
    mean = sum(sum(c.values()) for _, c in rows) / len(rows)
    merged = {}
    for i, c in rows:
        merged[i, sum(c.values())] = merged.get((i, sum(c.values())), Counter()) + c
    df = Counter(t for c in merged.values() for t in c)
    out = {}
    for q, text in asked:
        scores = {i: 0.0 for i, _ in docs if not exclude_self or i != q}
        for (i, n), c in merged.items():
            if i in scores:
                for t, f in Counter(text.split()).items():
                    idf = max(0.0, math.log((len(rows) - df[t] + 0.5) / (df[t] + 0.5) + 1)) if t in c else 0
                    scores[i] += f * idf * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * n / mean))
        out[q] = sorted(((i, round(s, 6)) for i, s in scores.items()), key=lambda x: (-x[1], x[0]))[:k]
    return out


@pytest.mark.parametrize(("block_terms", "least", "exclude_self"), [(10**6, 500, True), (150, 7, True), (150, 7, False)])
def test_best_of_blocks(spark, monkeypatch, block_terms, least, exclude_self):
    monkeypatch.setattr(retrieval, "BLOCK_TERMS", block_terms)
    monkeypatch.setattr(retrieval, "LEAST_QUERIES", least)
    docs = [(f"d{i}", t) for i, t in enumerate(texts(300, 1))]
    docs += [docs[5], ("d9", "the w1 w2 w3 w1")]  # a repeated row; two texts under one id
    asked = [*docs[10:60], ("new", "w1 w1 w2 w7 unheard"), ("blank", ""), ("unheard", "x y")]
    got = {}
    for r in retrieval.top_k(spark.createDataFrame(docs, "id string, question string"), spark.createDataFrame(asked, "query_id string, question string"), 4, exclude_self=exclude_self).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    want = expected(docs, asked, 4, exclude_self)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(s == pytest.approx(t, abs=1.1e-6) for q in want for (_, s), (_, t) in zip(got[q], want[q], strict=True))


def test_nothing_to_rank(spark):
    none = spark.createDataFrame([], "id string, question string")
    one = spark.createDataFrame([("a", "x y"), ("b", None)], "id string, question string")
    assert retrieval.top_k(none, one.withColumnRenamed("id", "query_id"), 2).count() == 0
    assert retrieval.top_k(one, none.withColumnRenamed("id", "query_id"), 2).count() == 0
    assert [tuple(r) for r in retrieval.top_k(one, one.withColumnRenamed("id", "query_id"), 2).orderBy("query_id").collect()] == [("a", "b", 0.0, 1), ("b", "a", 0.0, 1)]


def test_pairs_are_not_shuffled(spark):
    """All 3,000 rows share a word with all 1,000 queries: 3 million pairs, of which 3,000 are wanted."""
    rows = spark.range(3000).selectExpr("cast(id as string) id", "concat('common w', id % 700, ' v', id % 900) question").cache()
    rows.count()
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    time.sleep(2)
    before = written()
    assert retrieval.top_k(rows, rows.where("id < 1000").withColumnRenamed("id", "query_id"), 3).count() == 3000
    time.sleep(2)
    assert written() - before < 2_000_000
    rows.unpersist()


def test_demonstrations_without_shuffled_pairs(spark, tmp_path):
    """20,000 examples that all share a word with all 400 queries: 8 million pairs, of which 1,200 are wanted."""
    from corvane.plans import catalogue

    shared = ["concat('common w', id % 7000, ' v', id % 900) question", "concat('db', id % 90) db_id", "'select 1' gold_sql", "'easy' difficulty", "'t : a' schema_context"]
    spark.range(20000).selectExpr("concat('e_', id) example_id", *shared).write.parquet(str(tmp_path / "mock_spider.parquet"))
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    time.sleep(2)
    before = written()
    got = catalogue.queries()["prompts_with_demonstrations"](spark, str(tmp_path)).collect()
    time.sleep(2)
    assert len(got) == 400 and all((r["k_shots"], r["dropped"]) == (3, 0) for r in got)
    shuffled = written() - before
    assert shuffled < 12_000_000


def test_corpus_is_shuffled_once(spark):
    """20,000 rows and 6,000 queries, which are parted: no part takes a copy of the rows with it."""
    rows = spark.range(20000).selectExpr("cast(id as string) id", "concat('common w', id % 700, ' x', id, ' y', id * 7, ' z', id * 11) question").cache()
    rows.count()
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    time.sleep(2)
    before = written()
    assert retrieval.top_k(rows, rows.where("id % 10 < 3").withColumnRenamed("id", "query_id"), 3).count() == 18000
    time.sleep(2)
    shuffled = written() - before
    rows.unpersist()
    assert shuffled < 8_000_000


def test_rows_that_score_alike(spark, monkeypatch):
    """Rows that differ in words no query has: the least ids count, and a query's own id never does, in whatever block."""
    monkeypatch.setattr(retrieval, "BLOCK_TERMS", 300)
    docs = [(f"d{i:03}", f"open the gate {'now' if i % 3 else 'later'} n{i}") for i in range(200)] + [("d007", "close the gate")]
    asked = [(f"d{i:03}", f"the gate {'now' if i % 2 else 'later'} q{i}") for i in (0, 1, 2, 3, 7, 199)]
    got = {}
    for r in retrieval.top_k(spark.createDataFrame(docs, "id string, question string"), spark.createDataFrame(asked, "query_id string, question string"), 3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == {q: [i for i, _ in x] for q, x in expected(docs, asked, 3, True).items()}
