import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.functions import hashing
from corvane.operators import audit, integrity, prompts, results, retrieval, sampling, statistics, synthetic, training_pairs
from corvane.operators.running import running_sums
from corvane.plans import grids

EX = "id string, question string, db_id string, gold_sql string, split string"


def test_running_sums_match_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), i, rng.choice([1, 2, None])) for i in range(500)]
    got = {r["k"]: r["running"] for r in running_sums(spark.createDataFrame(rows, "g string, k int, w int").repartition(7), ["k"], "w", ["g"]).collect()}
    sums = defaultdict(int)
    for g, k, w in sorted(rows, key=lambda r: r[1]):
        sums[g] += w or 0
        assert got[k] == sums[g]
    assert running_sums(spark.createDataFrame([], "k int, w int"), ["k"], "w").count() == 0


def test_audit(spark):
    train = spark.createDataFrame([("t1", "How many singers do we have?", "a", "select 1", "train"), ("t2", "List all names of people here please now", "b", None, "dev"), ("t3", " ", None, " ", None), ("x", "Same id", "c", "select 9", "train")], EX)
    other = spark.createDataFrame([("e1", "how many SINGERS do we have", "b", "SELECT 1;", "dev"), ("e2", "List all names of people here please", "z", None, "dev"), ("x", "same id!", "c", "select 9", "dev"), ("e4", None, None, None, None)], EX)
    assert [(r["train_id"], r["eval_id"]) for r in audit.exact_question_duplicates(train, other).collect()] == [("t1", "e1")]
    assert [(r["train_id"], r["eval_id"]) for r in audit.exact_sql_duplicates(train, other).collect()] == [("t1", "e1")]
    near = {(r["train_id"], r["eval_id"]): r["score"] for r in audit.fuzzy_overlaps(train, other, 4, "0.5").collect()}
    assert near == {("t1", "e1"): 1.0, ("t2", "e2"): 0.8}
    assert {r["db_id"] for r in audit.schema_overlaps(train, other).collect()} == {"b", "c"}
    assert {r["id"] for r in audit.split_leakage(train).collect()} == {"t2", "t3"}
    row = audit.audit_report(train, {"dev": other}, threshold="0.5").first()
    assert (row["pairs_compared"], row["exact_questions"], row["near_questions"], row["passed"]) == (16, 1, 2, False)
    with pytest.raises(ValueError, match="t2"):
        audit.assert_isolation(train)
    assert audit.isolation_offenders(train.withColumn("split", F.concat(F.lit(" "), F.upper("split")))).count() == 1
    audit.assert_isolation(train.where("id = 't1'"))
    with pytest.raises(ValueError, match="threshold"):
        audit.fuzzy_overlaps(train, other, threshold="0")


def test_fuzzy_overlaps_against_all_pairs(spark):
    rng = random.Random(5)
    say = lambda: " ".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 9)))
    a, b = [(f"a{i}", say()) for i in range(60)], [(f"b{i}", say()) for i in range(60)]
    grams = lambda s: {tuple(s.split()[i : i + 2]) for i in range(len(s.split()) - 1)}
    want = {(i, j) for i, x in a for j, y in b if len(grams(x) & grams(y)) * 2 >= len(grams(x) | grams(y))}
    df = lambda rows: spark.createDataFrame(rows, "id string, question string")
    got = {(r["train_id"], r["eval_id"]) for r in audit.fuzzy_overlaps(df(a), df(b), 2, "0.5").collect()}
    assert got == want and want


def test_retrieval(spark):
    corpus = spark.createDataFrame([("a", "red fox", "x"), ("b", "red red dog", "y"), ("c", "blue bird", "x")], "id string, question string, db_id string")
    asked = spark.createDataFrame([("a", "red fox", "x"), ("q", "", "x")], "query_id string, question string, db_id string")
    got = defaultdict(list)
    for r in retrieval.top_k(corpus, asked, 2).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["id"], r["score"] > 0))
    assert got == {"a": [("b", True), ("c", False)], "q": [("a", False), ("b", False)]}
    same = {(r["query_id"], r["id"]) for r in retrieval.top_k(corpus, asked, 2, group="db_id").collect()}
    assert same == {("a", "c"), ("q", "a"), ("q", "c")}
    assert retrieval.top_k(corpus, asked, 0).count() == 0


def test_nested_samples(spark):
    rows = [(f"r{i}", "abc"[0 if i < 50 else 1 if i < 80 else 2]) for i in range(100)]
    order = sampling.global_order(spark.createDataFrame(rows * 2, "id string, db_id string"), 42).collect()
    assert sorted(r["place"] for r in order) == list(range(1, 101))
    again = sampling.global_order(spark.createDataFrame(rows, "id string, db_id string").repartition(5), 42).collect()
    assert {(r["id"], r["place"]) for r in order} == {(r["id"], r["place"]) for r in again}
    counts = {(r["size"], r["db_id"]): r["n"] for r in sampling.stratum_counts(sampling.nested_samples(sampling.global_order(spark.createDataFrame(rows, "id string, db_id string"), 42), [10, 20])).collect()}
    assert counts[10, "a"], counts[10, "b"] == (5, 3)
    assert counts[10, "c"] == 2


def test_results(spark):
    df = lambda rows: spark.createDataFrame(rows, "a int, b double, c string")
    same = results.compare_results(df([(1, 0.12341, " x"), (2, None, "y"), (2, None, "y")]), df([(2, None, "y"), (1, 0.12342, "x"), (2, None, "y")])).first()
    assert same["matches"] and same["tag"] is None
    assert not results.compare_results(df([(1, 0.5, "x")]), df([(1, 0.6, "x")])).first()["matches"]
    assert results.compare_results(df([]), df([])).first()["tag"] == "AMBIGUOUS_EMPTY_SET"
    rows = df([(3, 1.0, "x"), (1, 2.0, "y"), (2, 3.0, "z")]).repartition(3)
    assert results.compare_results(rows.orderBy("a"), rows.orderBy("a"), ordered=True).first()["matches"]
    assert results.compare_results(rows.orderBy("a"), rows.orderBy("c"), ordered=True).first()["tag"] == "ORDER_BY_MISMATCH"


def test_statements(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert results.run_sql(spark, "select count(*) from three;")[:2] == ("SUCCESS", [(3,)])
    assert results.run_sql(spark, "selec 1")[0] == "SYNTAX_ERROR"
    assert results.run_sql(spark, " ")[0] == "SYNTAX_ERROR"
    assert results.run_sql(spark, "select x from three")[0] == "EXECUTION_ERROR"
    assert results.run_sql(spark, "drop view three")[0] == "EXECUTION_ERROR"
    assert results.run_sql(spark, "create table t as select 1")[0] == "EXECUTION_ERROR"
    spark.sql("create table if not exists kept_table using parquet as select 1 as a")
    for write in ("alter table kept_table rename to lost", "alter table kept_table add columns (b int)", "alter table kept_table set tblproperties ('x' = 'y')", "use default", "cache table kept_table", "analyze table kept_table compute statistics", "refresh table kept_table", "load data inpath 'x' into table kept_table", "explain select 1", "set x = 1", "insert into kept_table values (2)", "with t as (select 1 as a) insert into kept_table select a from t", "from kept_table insert overwrite kept_table select 3", "select java_method('java.lang.System', 'getProperty', 'user.name')"):
        assert results.run_sql(spark, write)[0] == "EXECUTION_ERROR", write
    assert results.run_sql(spark, "with t as (select a from kept_table) select a from t union all values (1) order by 1")[:2] == ("SUCCESS", [(1,), (1,)])
    assert [f.name for f in spark.table("kept_table").schema] == ["a"]
    spark.sql("drop table kept_table")
    assert results.run_sql(spark, "select count(*) from range(3000000000) a where hash(id) = 5 and pmod(hash(id, id), 7) = 3", timeout=0.5)[0] == "TIMEOUT"
    pairs = [("p1", "select 1 as a", "select 1.0 as b"), ("p2", "selec", "select 1"), ("p3", None, "select 1"), ("p4", "select 2", "select 1"), ("p5", "select 1", "nonsense")]
    got = {r["example_id"]: (r["execution_match"], r["syntax_valid"], r["anomaly"]) for r in results.score_pairs(spark, pairs).collect()}
    assert got == {"p1": (1.0, True, None), "p2": (0.0, False, "SYNTAX_ERROR"), "p3": (0.0, False, "MISSING_GENERATION"), "p4": (0.0, True, "EXECUTION_MISMATCH"), "p5": (0.0, False, "GOLD_EXECUTION_FAILURE")}
    shares = results.rates(results.score_pairs(spark, pairs), ["execution_match"]).first()
    assert (shares["n"], shares["execution_match_rate"]) == (5, 0.2)


def test_results_over_the_cap_are_compared_whole(spark):
    pairs = [("same", "SELECT 6000 - id AS a FROM range(1, 6001)", "SELECT id AS a FROM range(6000)"), ("beyond", "SELECT if(id = 5999, -1, id) AS a FROM range(6000)", "SELECT id AS a FROM range(6000)")]
    got = {r["example_id"]: r["execution_match"] for r in results.score_pairs(spark, pairs, timeout=60.0).collect()}
    assert got == {"same": 1.0, "beyond": 0.0}


def test_nearest_rank_and_last_record(spark):
    rows = spark.createDataFrame([("m", float(v)) for v in range(1, 11)] + [("n", None), (None, 4.0), (None, 4.0)], "model string, v double")
    got = {r["model"]: (r["n"], r["p50"], r["p95"]) for r in results.nearest_rank(rows, ["model"], "v").collect()}
    assert got == {"m": (10, 6.0, 10.0), "n": (0, 0.0, 0.0), None: (2, 4.0, 4.0)}
    assert tuple(results.nearest_rank(rows, [], "v").first()) == (12, 5.0, 10.0)
    assert tuple(results.nearest_rank(rows.limit(0), [], "v").first()) == (0, 0.0, 0.0)
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, pos int, v string")
    assert {tuple(r) for r in results.last_predictions(log, "k", ["pos"]).collect()} == {("a", 2, "y"), ("b", 1, None)}


def test_statistics(spark):
    assert statistics.numpy_bootstrap([]) == (0.0, 0.0)
    assert statistics.numpy_bootstrap([1.0] * 9) == (1.0, 1.0)
    low, high = statistics.numpy_bootstrap([1.0] * 60 + [0.0] * 40)
    assert 0.45 < low < 0.6 < high < 0.75 and (low, high) == statistics.numpy_bootstrap([1.0] * 60 + [0.0] * 40)
    a, b = (spark.createDataFrame([(i, float(i % k == 0)) for i in range(40)] + [(90 + k, None)], "k int, x double") for k in (2, 8))
    row = statistics.paired_runs(a, b, "k", "x").first()
    assert tuple(row) == (40, 0.5, 0.125, 0.375, 15, 0)
    pairs = a.where("x is not null").join(b.withColumnRenamed("x", "y"), "k")
    row = statistics.paired_bootstrap(pairs, "k", "x", "y").first()
    assert row["mean"] == 0.375 and 0 < row["lower"] < 0.375 < row["upper"] and row["significant"]
    assert statistics.paired_bootstrap(pairs.limit(0), "k", "x", "y").first()["significant"] is False
    got = statistics.mcnemar_test(spark.createDataFrame([(10, 10), (25, 5), (0, 0)], "b bigint, c bigint")).orderBy("b").collect()
    assert [r["statistic"] for r in got] == [0.0, 0.05, 12.0333]
    assert got[0]["p_value"] == 1.0 and got[2]["p_value"] < 0.001
    pts = spark.createDataFrame([(500, 0.5), (1000, 0.55), (2000, 0.6), (4000, 0.65)], "n int, y double")
    fit = statistics.log_linear_fit(pts, "n", "y").first()
    assert fit["r_squared"] == 1.0 and abs(fit["b"] - 0.072135) < 1e-6
    assert statistics.log_linear_fit(pts.limit(1), "n", "y").first()["a"] is None
    assert statistics.power_law_fit(pts, "n", "y").first()["r_squared"] > 0.9
    assert statistics.power_law_fit(pts.limit(2), "n", "y").count() == 0
    front = statistics.pareto_frontier(spark.createDataFrame([(1, 5), (2, 4), (3, 7), (3, 6), (4, 7), (None, 9)], "c int, g int"), "c", "g")
    assert {tuple(r) for r in front.collect()} == {(1, 5), (3, 7)}
    adjusted = statistics.benjamini_hochberg(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double"), "k", "p")
    assert {r["k"]: round(r["adjusted"], 4) for r in adjusted.collect()} == {"a": 0.03, "b": 0.04, "c": 0.04}
    bounds = statistics.bootstrap_counts(spark.createDataFrame([("g", float(i % 2)) for i in range(200)], "g string, s double"), ["g"], "s").first()
    assert bounds["n"] == 200 and 0.4 < bounds["lower"] < 0.5 < bounds["upper"] < 0.6


def test_prompts(spark):
    columns = spark.createDataFrame([("d", 0, "B t", 1, "id", "INTEGER", True, None, None, "key"), ("d", 1, "a", 2, "x", "TEXT", False, "B t", "id", None)], "db_id string, table_no int, table_name string, column_no int, column_name string, data_type string, is_primary_key boolean, foreign_table string, foreign_column string, description string")
    assert prompts.ddl(columns, comments=True).first()["schema_text"] == 'CREATE TABLE a (\n  x TEXT,\n  FOREIGN KEY (x) REFERENCES "B t" (id)\n);\n\nCREATE TABLE "B t" (\n  id INTEGER, -- key\n  PRIMARY KEY (id)\n);'
    assert prompts.compact(columns).first()["schema_text"] == "a : x (TEXT, FK->B t.id)\nB t : id (INTEGER, PK)"
    assert '"table_name":"a"' in prompts.as_json(columns).first()["schema_text"]
    with pytest.raises(ValueError, match="xml"):
        prompts.serializer("xml")
    schemas = prompts.serializer("compact_pipe")(columns)
    examples = spark.createDataFrame([("e", "d", " How many? ", " hint ")], "example_id string, db_id string, question string, evidence string")
    shots = spark.createDataFrame([("e", 1, "Q1", "select 1"), ("e", 2, "Q2 " * 50, "select 2")], "example_id string, rank int, question string, gold_sql string")
    whole = prompts.assemble(examples, schemas, 4096, shots).first()
    assert whole["k_shots"] == 2 and whole["prompt_text"].endswith("### Question:\nHow many?\n\n### SQL Query:\nSELECT ")
    cut = prompts.assemble(examples, schemas, whole["tokens"] - 1, shots).first()
    assert (cut["k_shots"], cut["dropped"], cut["over_budget"]) == (1, 1, False)
    assert prompts.assemble(examples, schemas, 5, shots).first()["over_budget"]


def test_training_pairs(spark):
    rows = spark.createDataFrame([("a", "q", "d", "select 1", "train"), ("b", "q", "d", " ", "train"), ("c", "q", "zz", "s", "train"), ("e", "q", "d", "s", "dev")], EX)
    pairs, rejects = training_pairs.training_pairs(rows, spark.createDataFrame([("d", "schema")], "db_id string, schema_text string"))
    assert [(r["id"], r["target_text"]) for r in pairs.collect()] == [("a", "select 1;")]
    assert {tuple(r) for r in rejects.collect()} == {("b", "blank_sql"), ("c", "unknown_schema"), ("e", "split")}
    assert training_pairs.pair_summary(pairs, rejects).first()["n_rejected"] == 3
    texts = spark.createDataFrame([(1, "b a b"), (2, "c a")], "o int, t string")
    vocab = training_pairs.vocabulary(texts, "t", "o")
    assert {r["token"]: r["token_id"] for r in vocab.collect()} == {"b": 2, "a": 3, "c": 4}
    assert {r["o"]: r["x"] for r in training_pairs.encoded(texts, "o", "t", vocab, "x").collect()} == {1: [2, 3, 2], 2: [4, 3]}
    ids = spark.createDataFrame([("k", [5, 6, 7], [8, 9]), ("l", [5], [1])], "id string, prompt_ids array<bigint>, target_ids array<bigint>")
    got = {r["id"]: r for r in training_pairs.masked_labels(ids, 5).collect()}
    assert got["k"]["labels"] == [-100, -100, -100, 8, 9] and got["k"]["is_truncated"] and got["k"]["target_truncated"]
    assert got["l"]["input_ids"] == [5, 1] and not got["l"]["is_truncated"]
    left = {r["id"]: r for r in training_pairs.padded(training_pairs.masked_labels(ids, 5).withColumn("b", F.lit(1)), "b", "left").collect()}
    assert left["l"]["input_ids"] == [0, 0, 0, 5, 1] and left["l"]["attention_mask"] == [0, 0, 0, 1, 1]


def test_synthetic(spark):
    rows = spark.createDataFrame([("s1", 1, "How many?", "select 1"), ("s2", 2, "how many", "SELECT 1;"), ("s2", 3, "drop it", "drop table x"), ("s4", 4, None, None), ("s5", 5, "seen", "select 5")], "synthetic_id string, pos int, question string, sql string")
    evaluation = spark.createDataFrame([("Seen?", "x", None), (None, None, None)], "question string, gold_sql string, extra string")
    flags = synthetic.record_flags(rows, evaluation)
    got = {r["pos"]: r["reasons"] for r in flags.collect()}
    assert got == {1: [], 2: ["repeated_pair"], 3: ["unsafe", "repeated_id"], 4: [], 5: ["contaminated"]}
    assert {r["reason"]: r["n"] for r in synthetic.reason_histogram(flags).collect()} == Counter(["repeated_pair", "unsafe", "repeated_id", "contaminated"])
    assert not synthetic.corpus_verdict(flags).first()["all_clean"]


def test_hashes_and_manifests(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    first = hashing.content_hash(rows, "k", ["k", "v"]).first()
    assert first == hashing.content_hash(rows.orderBy(F.desc("k")).repartition(3), "k", ["k", "v"]).first()
    assert first != hashing.content_hash(rows.where("k = 'a'"), "k", ["k", "v"]).first()
    with pytest.raises(ValueError, match="more than 1"):
        hashing.ordered_hash(rows, ["k"], "k", 1)
    (tmp_path / "f.txt").write_text("abc")
    disk = integrity.folder_hashes(spark, str(tmp_path))
    assert disk.first()["sha256"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert integrity.manifest_differences(disk, disk).count() == 0


def test_grids(spark):
    grid = {(r["rank"], r["modules"]): r["parameters"] for r in grids.run_grid(spark, [8, 64], ["all-linear"], [1]).collect()}
    assert grid == {(8, "all-linear"): 20_185_088, (64, "all-linear"): 161_480_704}
    plan = grids.scaling_grid(spark, [500], [1, 2])
    assert sum(r["cached"] for r in grids.pending_runs(plan, plan.where("seed = 1")).collect()) == 1
