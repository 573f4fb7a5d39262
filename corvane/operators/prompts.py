"""Schema serialisation and prompt assembly as column expressions.

Schemas come as the rows of ``schema_columns``: (db_id, table_no, table_name, column_no, column_name, data_type,
is_primary_key, foreign_table, foreign_column) and optionally ``description``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import quote_identifier, token_estimate, trimmed

#: Section heads of the prompts.
INSTRUCTION = "Given the database schema below, write a syntactically valid SQLite query that accurately answers the question."


def _tables(columns: DataFrame, line: Column, extra: list[Column]) -> DataFrame:
    """(db_id, table_no, table_name, lines): each table's lines in column order."""
    cols = columns.withColumn("_line", line)
    return cols.groupBy("db_id", "table_no", "table_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("column_no", "_line"))), lambda s: s["_line"]).alias("lines"), *extra)


def _joined(tables: DataFrame, text: Column, glue: str) -> DataFrame:
    """(db_id, schema_text): the tables' texts by lower-cased name."""
    made = tables.select("db_id", F.struct(F.lower("table_name").alias("k"), "table_no", text.alias("t")).alias("s"))
    return made.groupBy("db_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), glue).alias("schema_text"))


def found_tables(columns: DataFrame, asked: DataFrame, name: str) -> DataFrame:
    """The columns of the tables that ``asked`` names in column ``name``, whatever the case; names without a table have no row."""
    return asked.select(name).distinct().join(columns, F.lower(F.col(name)) == F.lower("table_name"))


def ddl(columns: DataFrame, comments: bool = False) -> DataFrame:
    """(db_id, schema_text): CREATE TABLE statements; primary key, then foreign keys grouped by target.

    Descriptions, if asked for and there, stand behind the comma of their line, so that a comment never hides one.
    """
    q = quote_identifier
    line = F.concat(F.lit("  "), q(F.col("column_name")), F.lit(" "), F.coalesce("data_type", F.lit("TEXT")))
    note = F.when(F.length(trimmed(F.col("description"))) > 0, F.concat(F.lit(" -- "), trimmed(F.col("description")))) if comments and "description" in columns.columns else F.lit(None).cast("string")
    keyed = columns.withColumn("_note", note)
    pk = F.transform(F.array_sort(F.collect_list(F.when(F.col("is_primary_key"), F.struct("column_no", q(F.col("column_name")).alias("c"))))), lambda s: s["c"])
    fk = F.array_sort(F.collect_list(F.when(F.col("foreign_table").isNotNull(), F.struct(F.lower("foreign_table").alias("k"), "column_no", F.col("foreign_table").alias("t"), q(F.col("column_name")).alias("c"), q(F.col("foreign_column")).alias("f")))))
    rows = keyed.withColumn("_line", line).groupBy("db_id", "table_no", "table_name").agg(F.array_sort(F.collect_list(F.struct("column_no", "_line", "_note"))).alias("cols"), pk.alias("pk"), fk.alias("fk"))
    targets = F.array_distinct(F.transform("fk", lambda s: s["t"]))
    foreign = F.transform(targets, lambda t: F.concat(F.lit("  FOREIGN KEY ("), F.array_join(F.transform(F.filter("fk", lambda s: s["t"] == t), lambda s: s["c"]), ", "), F.lit(") REFERENCES "), q(t), F.lit(" ("), F.array_join(F.transform(F.filter("fk", lambda s: s["t"] == t), lambda s: s["f"]), ", "), F.lit(")")))
    primary = F.when(F.size("pk") > 0, F.array(F.concat(F.lit("  PRIMARY KEY ("), F.array_join("pk", ", "), F.lit(")")))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(F.transform("cols", lambda s: F.struct(s["_line"].alias("a"), s["_note"].alias("b"))), F.transform(F.concat(primary, foreign), lambda x: F.struct(x.alias("a"), F.lit(None).cast("string").alias("b"))))
    last = F.size("ls") - 1
    body = F.array_join(F.transform("ls", lambda s, i: F.concat(s["a"], F.when(i < last, F.lit(",")).otherwise(F.lit("")), F.coalesce(s["b"], F.lit("")))), "\n")
    made = rows.withColumn("ls", lines)
    return _joined(made, F.concat(F.lit("CREATE TABLE "), q(F.col("table_name")), F.lit(" (\n"), body, F.lit("\n);")), "\n\n")


def compact(columns: DataFrame) -> DataFrame:
    """(db_id, schema_text): one line per table, ``name : column (TYPE, PK, FK->t.c) | ...``."""
    mods = F.array_compact(F.array(F.upper("data_type"), F.when(F.col("is_primary_key"), F.lit("PK")), F.when(F.col("foreign_table").isNotNull(), F.concat(F.lit("FK->"), "foreign_table", F.lit("."), "foreign_column"))))
    token = F.when(F.size(mods) > 0, F.concat("column_name", F.lit(" ("), F.array_join(mods, ", "), F.lit(")"))).otherwise(F.col("column_name"))
    return _joined(_tables(columns, token, []), F.concat("table_name", F.lit(" : "), F.array_join("lines", " | ")), "\n")


def as_json(columns: DataFrame) -> DataFrame:
    """(db_id, schema_text): the schema as JSON, tables by lower-cased name."""
    cols = F.transform(F.array_sort(F.collect_list(F.struct("column_no", F.col("column_name").alias("name"), "data_type", "is_primary_key", "foreign_table", "foreign_column"))), lambda s: F.struct(s["name"].alias("name"), s["data_type"].alias("data_type"), s["is_primary_key"].alias("is_primary_key"), s["foreign_table"].alias("foreign_table"), s["foreign_column"].alias("foreign_column")))
    tables = columns.groupBy("db_id", "table_no", "table_name").agg(cols.alias("columns"))
    listed = tables.groupBy("db_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.lower("table_name").alias("k"), "table_no", "table_name", "columns"))), lambda s: F.struct(s["table_name"].alias("table_name"), s["columns"].alias("columns"))).alias("tables"))
    return listed.select("db_id", F.to_json(F.struct("db_id", "tables"), {"ignoreNullFields": "false"}).alias("schema_text"))


def serializer(name: str):  # noqa: ANN201
    """The serialiser of a format name."""
    known = {"ddl": ddl, "compact": compact, "pipe": compact, "compact_pipe": compact, "json": as_json}
    if name.strip().lower() not in known:
        raise ValueError(f"unknown schema format {name!r}; known are {', '.join(sorted(known))}")
    return known[name.strip().lower()]


def prompt_text(db_id: Column, schema_text: Column, question: Column, evidence: Column | None = None, demonstrations: Column | None = None, stub: str | None = "SELECT ", instruction: str = INSTRUCTION) -> Column:
    """A prompt's sections in fixed order. ``demonstrations``: array of struct(question, gold_sql), the best first;
    ``stub`` ends an inference prompt, None a training prompt."""
    none = F.array().cast("array<string>")
    head = F.array(F.lit("### Instructions:"), F.lit(instruction.strip()), F.lit(""), F.concat(F.lit("### Database Schema ("), db_id, F.lit("):")), trimmed(schema_text), F.lit(""))
    hint = none if evidence is None else F.when(F.length(trimmed(evidence)) > 0, F.array(F.lit("### Domain Evidence:"), trimmed(evidence), F.lit(""))).otherwise(none)
    shots = none
    if demonstrations is not None:
        one = F.transform(demonstrations, lambda d, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit(":\nQuestion: "), trimmed(d["question"]), F.lit("\nSQL: "), trimmed(d["gold_sql"])))
        shots = F.when(F.size(demonstrations) > 0, F.array(F.concat(F.lit("### Examples:\n"), F.array_join(one, "\n\n")), F.lit(""))).otherwise(none)
    tail = F.array(F.lit("### Question:"), trimmed(question), F.lit(""), F.lit("### SQL Query:"), F.lit(stub or ""))
    return F.array_join(F.concat(head, hint, shots, tail), "\n")


def assemble(examples: DataFrame, schemas: DataFrame, budget: int = 4096, demonstrations: DataFrame | None = None, key: str = "example_id", plain_schemas: DataFrame | None = None) -> DataFrame:
    """(key, db_id, prompt_text, k_shots, tokens, dropped, plain_schema, over_budget) for every example.

    Prompts over the budget lose demonstrations, the lowest rank first, then the comments of their schema
    (``plain_schemas``); what is still too long keeps its text and is marked. ``schemas``: (db_id, schema_text);
    ``demonstrations``: (key, rank, question, gold_sql). Token estimates of all prefixes are columns, so nothing loops.
    """
    evidence = F.col("evidence") if "evidence" in examples.columns else None
    rows = examples.select(key, "db_id", "question", *(["evidence"] if evidence is not None else [])).join(schemas.select("db_id", "schema_text"), "db_id")
    rows = rows.join(plain_schemas.select("db_id", F.col("schema_text").alias("_plain")), "db_id", "left") if plain_schemas is not None else rows.withColumn("_plain", F.col("schema_text"))
    if demonstrations is not None:
        shots = demonstrations.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "question", "gold_sql"))), lambda s: F.struct(s["question"].alias("question"), s["gold_sql"].alias("gold_sql"))).alias("_shots"))
        rows = rows.join(shots, key, "left")
    else:
        rows = rows.withColumn("_shots", F.lit(None).cast("array<struct<question:string,gold_sql:string>>"))
    rows = rows.withColumn("_shots", F.coalesce("_shots", F.array().cast("array<struct<question:string,gold_sql:string>>")))
    text = lambda schema, k: prompt_text(F.col("db_id"), schema, F.col("question"), evidence, F.slice("_shots", F.lit(1), k))
    tried = F.transform(F.sequence(F.lit(0), F.size("_shots")), lambda k: F.struct(k.alias("k"), text(F.col("schema_text"), k).alias("t")))
    fits = F.filter("_tried", lambda s: token_estimate(s["t"]) <= budget)
    best = F.element_at("_fits", -1)
    plain = text(F.coalesce("_plain", "schema_text"), F.lit(0))
    rows = rows.withColumn("_tried", tried).withColumn("_fits", fits).withColumn("_any", F.size("_fits") > 0)
    picked = rows.withColumn("k_shots", F.when(F.col("_any"), best["k"]).otherwise(F.lit(0))).withColumn("prompt_text", F.when(F.col("_any"), best["t"]).otherwise(plain))
    tokens = token_estimate(F.col("prompt_text"))
    return picked.select(key, "db_id", "prompt_text", "k_shots", tokens.alias("tokens"), (F.size("_shots") - F.col("k_shots")).alias("dropped"), (~F.col("_any")).alias("plain_schema"), (tokens > budget).alias("over_budget"))
