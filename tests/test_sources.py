import json

import pytest
from pyspark.sql import functions as F

from corvane.sources import benchmarks, sinks
from corvane.streaming import predictions

CATALOG = [{"db_id": "d", "table_names_original": ["T", "u"], "table_names": ["t", "u"], "column_names_original": [[-1, "*"], [0, "id"], [1, "t_id"], [1, "note"]], "column_names": [[-1, "*"], [0, "id"], [1, "t id"], [1, "note"]], "column_types": ["text", "number", "number", "text"], "primary_keys": [1], "foreign_keys": [[2, 1], [3], [2, 99]]}]


def put(path, data):
    path.write_text(json.dumps(data))
    return str(path)


def test_schema_columns(spark, tmp_path):
    rows = {r["column_name"]: r for r in benchmarks.schema_columns(spark, put(tmp_path / "t.json", CATALOG)).collect()}
    assert set(rows) == {"id", "t_id", "note"}
    assert rows["id"]["is_primary_key"] and rows["id"]["data_type"] == "NUMBER" and rows["id"]["table_name"] == "T"
    assert (rows["t_id"]["foreign_table"], rows["t_id"]["foreign_column"]) == ("T", "id")
    with pytest.raises(ValueError, match="without tables"):
        benchmarks.schema_columns(spark, put(tmp_path / "x.json", [{"db_id": "e", "table_names": [], "column_names": []}]))


def test_example_files(spark, tmp_path):
    rows = [{"db_id": "d", "question": " q1 ", "query": "select 1"}, {"db_id": "d", "question": "q2", "query": "select 2"}]
    got = benchmarks.numbered_examples(spark, put(tmp_path / "a.json", rows), "train", "spider").orderBy("pos").collect()
    assert [(r["id"], r["question"]) for r in got] == [("spider_train_00000", "q1"), ("spider_train_00001", "q2")]
    with pytest.raises(ValueError, match="blank question"):
        benchmarks.numbered_examples(spark, put(tmp_path / "b.json", [{"db_id": "d", "question": " ", "query": "x"}]), "train", "spider")
    with pytest.raises(ValueError, match="unknown database"):
        benchmarks.numbered_examples(spark, str(tmp_path / "a.json"), "train", "spider", known=spark.createDataFrame([("z",)], "db_id string"))
    variant = [{"db_id": "d", "question": "q", "SQL": "select 1", "question_id": 7, "difficulty": "moderate", "evidence": " "}]
    one = benchmarks.variant_examples(spark, put(tmp_path / "c.json", variant), "sqlite").first()
    assert (one["id"], one["difficulty"], one["evidence"]) == ("bird_sqlite_7", "medium", None)
    with pytest.raises(ValueError, match="expected 2"):
        benchmarks.variant_examples(spark, str(tmp_path / "c.json"), "sqlite", expected=2)
    with pytest.raises(ValueError, match="repeated id"):
        benchmarks.variant_examples(spark, put(tmp_path / "d.json", variant * 2), "sqlite")
    held = benchmarks.held_out_examples(spark, put(tmp_path / "e.json", [{"question": "q", "gold_sql": "s", "difficulty": "odd"}]), "h").first()
    assert (held["id"], held["db_id"], held["difficulty"], held["split"]) == ("custom_held_out_0000", "h", "unclassified", "held_out")


def test_fixtures_and_logs(spark, tmp_path):
    row = {"example_id": "b", "question": "q", "db_id": "d", "schema_context": "c", "gold_sql": "s"}
    got = benchmarks.fixture_examples(spark, put(tmp_path / "f.json", [row, row | {"example_id": "a"}])).collect()
    assert [r["example_id"] for r in got] == ["a", "b"]
    (tmp_path / "g.jsonl").write_text('{"example_id": "x", "latency_ms": 1.0}\n\n{"example_id": "x", "latency_ms": 2.0}\n{"exam')
    assert [(r["example_id"], r["latency_ms"]) for r in benchmarks.prediction_log(spark, str(tmp_path / "g.jsonl")).collect()] == [("x", 2.0)]
    good, bad = benchmarks.json_lines(spark, str(tmp_path / "g.jsonl"), "example_id string, latency_ms double")
    assert good.count() == 2 and [r["value"] for r in bad.collect()] == ['{"exam']
    (tmp_path / "run" / "checkpoint-20").mkdir(parents=True)
    (tmp_path / "run" / "checkpoint-20" / "x").write_text("1")
    assert [r["step"] for r in benchmarks.checkpoints(spark, str(tmp_path / "run")).collect()] == [20]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("b", None), ("a", 1)], "k string, v int")
    sinks.write_sorted_json(rows, str(tmp_path / "s"), "k", one_file=True)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "s")).collect()] == ['{"k":"a","v":1}', '{"k":"b","v":null}']
    sinks.append_log(rows, str(tmp_path / "l"))
    sinks.append_log(rows, str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).count() == 4
    sinks.write_csv(rows.coalesce(1), str(tmp_path / "c"), ["k", "v"])
    assert {r["value"] for r in spark.read.text(str(tmp_path / "c")).collect()} == {"k,v", "b,", "a,1"}
    sinks.write_metrics(rows.agg(F.count("v").alias("n")), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first()["n"] == 1
    assert "<svg" in sinks.frontier_svg([(1.0, 0.5, True), (2.0, 0.4, False)], "t")
    (tmp_path / "p.json").write_text(json.dumps({"size": 1, "seed": 1, "ids": ["a"], "ids_hash": "0"}))
    with pytest.raises(ValueError, match="size 1"):
        sinks.read_samples(spark, str(tmp_path / "p.json"))


def test_stream(spark, tmp_path):
    rows = spark.sql("select 'e' example_id, 's' generated_sql, 2.0D latency_ms, 'length' finish_reason, 'm' model_id, timestamp'2025-01-01 10:00:00' logged_at")
    rows.write.parquet(str(tmp_path / "in"))
    got = predictions.run_once(predictions.windowed_latency(predictions.prediction_stream(spark, str(tmp_path / "in")))).first()
    assert (got["n"], got["mean_latency"], got["n_cut"]) == (1, 2.0, 1)


def test_mean_of_the_stream_is_compared(spark, tmp_path):
    from corvane.plans import catalogue

    rows = spark.sql("select 'e' example_id, 's' generated_sql, col1 latency_ms, 'stop' finish_reason, 'm' model_id, timestamp'2025-01-01 10:00:00' logged_at from values (0.1D), (0.2D), (0.6D), (cast(null as double))")
    rows.coalesce(1).write.parquet(str(tmp_path / "generation_result.parquet"))
    got = catalogue.queries()["stream_mean_latency"](spark, str(tmp_path)).first()
    assert got["mean_latency"] == 0.9 / 3 and "mean_latency" in catalogue.oracle_sql()["stream_mean_latency"]


def test_databases_and_config(spark, tmp_path):
    from corvane.operators import prompts
    from corvane.sources import databases

    columns = databases.built_in_columns(spark)
    assert columns.count() == 40 and columns.where("foreign_table is not null").count() == 5
    assert "invoices : invoice_id (INTEGER, PK) | subscription_id (INTEGER, FK->subscriptions.subscription_id)" in prompts.compact(columns).first()["schema_text"]
    spark.range(2).write.parquet(str(tmp_path / "database" / "d" / "two.parquet"))
    folder = databases.database_folder("d", [str(tmp_path / "none"), str(tmp_path)])
    assert databases.register_database(spark, folder) == ["two"] and spark.table("two").count() == 2
    assert databases.database_folder("e", [str(tmp_path)]) is None
    (tmp_path / "c.json").write_text('{"a": 1}')
    assert databases.load_config(str(tmp_path / "c.json")) == {"a": 1}
    (tmp_path / "l.json").write_text("[1]")
    with pytest.raises(ValueError, match="no mapping"):
        databases.load_config(str(tmp_path / "l.json"))


def test_cli(spark, tmp_path, capsys):
    from corvane import cli

    assert cli.main(["queries"]) == 0 and "fuzzy_overlap" in capsys.readouterr().out
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    assert cli.main(["sql", str(tmp_path), "select count(*) from t"]) == 0 and "3" in capsys.readouterr().out
    assert cli.main(["sql", str(tmp_path), "select from"]) == 1
    rows = spark.createDataFrame([("a", "q one", "d", "select 1", "train")], "id string, question string, db_id string, gold_sql string, split string")
    rows.write.parquet(str(tmp_path / "x.parquet"))
    assert cli.main(["audit", str(tmp_path / "x.parquet"), str(tmp_path / "x.parquet")]) == 1
    assert cli.main(["sample", str(tmp_path / "x.parquet"), str(tmp_path / "out"), "--sizes", "1"]) == 0
