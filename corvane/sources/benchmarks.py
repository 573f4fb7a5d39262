"""Benchmark files as DataFrames: schema catalogues, example files, JSON lines.

Files of this kind are one JSON array; each is read as one text so that an element's place, which gives its id, is
known. They are small by nature (a benchmark's split); larger corpora come as JSON lines or Parquet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import trimmed

CATALOG = """array<struct<db_id: string, table_names_original: array<string>, table_names: array<string>,
    column_names_original: array<array<string>>, column_names: array<array<string>>, column_types: array<string>,
    primary_keys: array<int>, foreign_keys: array<array<int>>>>"""
EXAMPLE = "array<struct<id: string, example_id: string, question_id: bigint, question: string, query: string, SQL: string, gold_sql: string, db_id: string, evidence: string, difficulty: string>>"

#: Difficulty names of one benchmark in the common scale.
DIFFICULTY = {"simple": "easy", "moderate": "medium", "challenging": "hard"}
LEVELS = ("easy", "medium", "hard", "extra", "unclassified")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(pos, item): the elements of a file that holds one JSON array, with their places from 0."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", schema)).alias("pos", "item"))


def _blank(c: Column) -> Column:
    return F.coalesce(trimmed(c), F.lit("")) == ""


def refuse(df: DataFrame, bad: Column, what: str, shown: str = "pos") -> None:
    """Raise on the first row that ``bad`` holds for."""
    first = df.where(bad).orderBy(shown).limit(1).collect()
    if first:
        raise ValueError(f"{what}: row {first[0][shown]}")


def schema_columns(spark: SparkSession, path: str) -> DataFrame:
    """(db_id, table_no, table_name, column_no, column_name, data_type, is_primary_key, foreign_table, foreign_column):
    the columns of a schema catalogue.

    Original names are preferred; column 0, which stands for all, is dropped; types are upper case and TEXT if
    missing; foreign keys are resolved from column numbers, malformed pairs skipped. A database without id or
    tables is refused.
    """
    raw = json_array(spark, path, CATALOG).select("pos", "item.*")
    tables = F.coalesce(F.when(F.size("table_names_original") > 0, F.col("table_names_original")), F.col("table_names"))
    columns = F.coalesce(F.when(F.size("column_names_original") > 0, F.col("column_names_original")), F.col("column_names"))
    raw = raw.withColumn("tables", tables).withColumn("columns", columns)
    refuse(raw, _blank(F.col("db_id")), "a database without id")
    refuse(raw, F.coalesce(F.size("tables"), F.lit(0)) < 1, "a database without tables")
    refuse(raw, F.size("column_types").isNotNull() & (F.size("column_types") >= 0) & (F.size("column_types") != F.size("columns")), "column names and types differ in number")
    cols = raw.select("db_id", "tables", "column_types", "primary_keys", "foreign_keys", "columns", F.posexplode("columns").alias("column_no", "c")).where("column_no > 0")
    table_no = F.get("c", F.lit(0)).cast("int")
    pair = F.get(F.filter("foreign_keys", lambda p: (F.size(p) == 2) & (F.get(p, F.lit(0)) == F.col("column_no"))), F.lit(0))
    target = F.get("columns", F.get(pair, F.lit(1)))
    out = cols.select(
        F.col("db_id"), table_no.alias("table_no"), F.get("tables", table_no).alias("table_name"), "column_no", F.get("c", F.lit(1)).alias("column_name"),
        F.coalesce(F.upper(F.get("column_types", F.col("column_no"))), F.lit("TEXT")).alias("data_type"),
        F.coalesce(F.array_contains("primary_keys", F.col("column_no")), F.lit(False)).alias("is_primary_key"),
        F.when(F.get(pair, F.lit(1)) > 0, F.get("tables", F.get(target, F.lit(0)).cast("int"))).alias("foreign_table"),
        F.when(F.get(pair, F.lit(1)) > 0, F.get(target, F.lit(1))).alias("foreign_column"),
    )
    return out.where("table_name is not null")


def numbered_examples(spark: SparkSession, path: str, split: str, dataset: str, prefix: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """Examples whose ids come from their places: ``{prefix}_{place:05d}``, the prefix ``{dataset}_{split}`` by default.

    Question, query and db_id must not be blank; with ``known`` (db_id) the database must be among them.
    """
    rows = json_array(spark, path, EXAMPLE).select("pos", "item.*")
    rows = rows.withColumn("sql_", F.coalesce("query", "SQL", "gold_sql"))
    for c in ("question", "sql_", "db_id"):
        refuse(rows, _blank(F.col(c)), f"blank {c.rstrip('_')}")
    if known is not None:
        lost = rows.join(known.select("db_id").distinct(), "db_id", "left_anti")
        refuse(lost, F.lit(True), "unknown database")
    name = F.format_string("%s_%05d", F.lit(prefix or f"{dataset}_{split}"), F.col("pos"))
    return _examples(rows, name, dataset, split, F.lit("unclassified"))


def variant_examples(spark: SparkSession, path: str, variant: str, dataset: str = "bird_mini", expected: int | None = None) -> DataFrame:
    """Examples with question ids: ``bird_{variant}_{question_id, or the place}``; difficulty names mapped, blank
    evidence null; repeated ids and, with ``expected``, another number of rows are refused."""
    rows = json_array(spark, path, EXAMPLE).select("pos", "item.*").withColumn("sql_", F.coalesce("SQL", "query"))
    for c in ("question", "sql_", "db_id"):
        refuse(rows, _blank(F.col(c)), f"blank {c.rstrip('_')}")
    name = F.concat(F.lit(f"bird_{variant}_"), F.coalesce(F.col("question_id"), F.col("pos")).cast("string"))
    scale = F.coalesce(F.create_map(*[F.lit(x) for kv in DIFFICULTY.items() for x in kv])[F.lower(trimmed(F.col("difficulty")))], F.lit("unclassified"))
    out = _examples(rows, name, dataset, "dev", scale)
    if expected is not None and (n := out.count()) != expected:
        raise ValueError(f"expected {expected} examples, found {n}")
    return unique_ids(out)


def held_out_examples(spark: SparkSession, path: str, expected_db: str) -> DataFrame:
    """Held-out examples: id from example_id, id or the place; the database is the expected one or missing."""
    rows = json_array(spark, path, EXAMPLE).select("pos", "item.*").withColumn("sql_", F.coalesce("gold_sql", "query"))
    rows = rows.withColumn("db_id", F.coalesce(F.nullif(trimmed(F.col("db_id")), F.lit("")), F.lit(expected_db)))
    refuse(rows, F.col("db_id") != expected_db, "another database")
    for c in ("question", "sql_"):
        refuse(rows, _blank(F.col(c)), f"blank {c.rstrip('_')}")
    name = F.coalesce("example_id", "id", F.format_string("custom_held_out_%04d", F.col("pos")))
    level = F.lower(trimmed(F.col("difficulty")))
    return unique_ids(_examples(rows, name, "held_out_custom", "held_out", F.when(level.isin(*LEVELS), level).otherwise("unclassified")))


def _examples(rows: DataFrame, name: Column, dataset: str, split: str, difficulty: Column) -> DataFrame:
    return rows.select(
        "pos", name.alias("id"), trimmed(F.col("question")).alias("question"), trimmed(F.col("db_id")).alias("db_id"), trimmed(F.col("sql_")).alias("gold_sql"),
        F.lit(dataset).alias("dataset_name"), F.lit(split).alias("split"), difficulty.alias("difficulty"), F.nullif(trimmed(F.col("evidence")), F.lit("")).alias("evidence"),
    )


def unique_ids(df: DataFrame, key: str = "id") -> DataFrame:
    """The table itself if no id repeats."""
    twice = df.groupBy(key).count().where("count > 1").orderBy(key).limit(1).collect()
    if twice:
        raise ValueError(f"repeated id {twice[0][key]!r}")
    return df


def fixture_examples(spark: SparkSession, path: str) -> DataFrame:
    """(example_id, question, db_id, schema_context, gold_sql, difficulty) of a JSON array; non-empty, no blank field, unique ids, sorted."""
    schema = "array<struct<example_id: string, question: string, db_id: string, schema_context: string, gold_sql: string, difficulty: string>>"
    rows = json_array(spark, path, schema).select("pos", "item.*")
    if rows.isEmpty():
        raise ValueError("no examples")
    for c in ("example_id", "question", "db_id", "schema_context", "gold_sql"):
        refuse(rows, _blank(F.col(c)), f"blank {c}")
    return unique_ids(rows.drop("pos"), "example_id").withColumn("difficulty", F.coalesce("difficulty", F.lit("unclassified"))).orderBy("example_id")


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of a JSON-lines folder: blank lines are skipped, lines that are no record are returned as text."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    parsed = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    good = F.col("r").isNotNull() & F.col("r._bad").isNull()
    return parsed.where(good).select("r.*").drop("_bad"), parsed.where(~good).select("value")


def prediction_log(spark: SparkSession, path: str) -> DataFrame:
    """The last record of each example_id in a JSON-lines log of one file, in line order."""
    from corvane.operators.results import last_predictions

    fields = "example_id string, generated_sql string, prompt_tokens bigint, completion_tokens bigint, latency_ms double, finish_reason string, cost_usd double, model_id string"
    # splits of a file are numbered in its order, and lines within them
    lines = spark.read.text(path).select((F.col("_metadata.file_block_start")).alias("block"), F.monotonically_increasing_id().alias("at"), "value").where(F.length(F.trim("value")) > 0)
    rows = lines.select("block", "at", F.from_json("value", fields).alias("r")).select("block", "at", "r.*").where("example_id is not null")
    return last_predictions(rows, "example_id", ["block", "at"]).drop("block", "at")


def checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    """(path, step) of the ``checkpoint-<n>`` folders under a run's folder, found by their files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    found = files.select(F.regexp_extract("path", r"^(.*/checkpoint-\d+)/", 1).alias("path"), F.regexp_extract("path", r"/checkpoint-(\d+)/", 1).alias("step"))
    return found.where("step <> ''").select("path", F.col("step").cast("bigint").alias("step")).distinct()
