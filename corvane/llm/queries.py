"""The queries of this subpackage: name -> (spark, folder) -> DataFrame, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import broken_pairs, mixing, near_duplicates, passage_index, percentiles, pieces, radix_groups, related, stable_sample, text_index


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return related.torn_databases(_table(spark, folder, "db_catalog"), _table(spark, folder, "train_contaminated"))


def p1_splits(spark: SparkSession, folder: str) -> DataFrame:
    targets = {r["split"]: r["target_share"] for r in _table(spark, folder, "split_target").collect()}
    tables = {"mock_spider": (_table(spark, folder, "mock_spider"), "example_id"), "train_contaminated": (_table(spark, folder, "train_contaminated"), "id")}
    return related.split_records(_table(spark, folder, "db_catalog"), tables, targets)


def _similar_tables(spark: SparkSession, folder: str) -> list[near_duplicates.Table]:
    return [(_table(spark, folder, "mock_spider"), "example_id", ["question"]), (_table(spark, folder, "synthetic_record"), "synthetic_id", ["question", "sql"])]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.linked_pairs(_similar_tables(spark, folder)).select("id_a", "id_b").distinct()


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    origin = F.when(F.col("origin") == 0, "mock_spider").otherwise("synthetic_record")
    return near_duplicates.linked_groups(_similar_tables(spark, folder)).withColumn("origin", origin)


def p3_latency(spark: SparkSession, folder: str) -> DataFrame:
    return percentiles.daily_percentiles(_table(spark, folder, "generation_result"), ["model_id"], "latency_ms", "logged_at")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return broken_pairs.defects(_table(spark, folder, "synthetic_record"), labelled=_table(spark, folder, "documents").select("text", "lang"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return text_index.cross_split_pairs(_table(spark, folder, "train_contaminated"))


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    return text_index.cross_split_counts(_table(spark, folder, "train_contaminated"))


def p5_spans(spark: SparkSession, folder: str) -> DataFrame:
    return text_index.cross_split_spans(_table(spark, folder, "train_contaminated"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return radix_groups.formatting_copies(_table(spark, folder, "mock_spider"), _table(spark, folder, "mock_spider_raw")).where("n_copies > 1")


def p7_sample(spark: SparkSession, folder: str) -> DataFrame:
    return stable_sample.stable_sample(_table(spark, folder, "mock_spider"), "example_id", 0.1).select("example_id", "question", "db_id")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return passage_index.leaked_items(_table(spark, folder, "documents"), _table(spark, folder, "eval_passage"))


def p8_matches(spark: SparkSession, folder: str) -> DataFrame:
    return passage_index.passage_matches(_table(spark, folder, "documents"), _table(spark, folder, "eval_passage"), slop=3)


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(_table(spark, folder, "documents"), _table(spark, folder, "mix_target"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture_shares(p9_mixture(spark, folder), _table(spark, folder, "mix_target"))


def p10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.pieces(_table(spark, folder, "documents"), _table(spark, folder, "piece_limit"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_splits, p2_found, p2_groups, p3_latency, p4_found, p5_found, p5_counts, p5_spans, p6_found, p7_sample, p8_found, p8_matches, p9_mixture, p9_shares, p10_pieces)}


_BUCKET = """
    CASE WHEN v = 0 THEN 0.0 ELSE sign(v) * floor(abs(v) / pow(2.0, e - 9)) * pow(2.0, e - 9) END"""

_P3 = f"""
WITH x AS (SELECT model_id, CAST(logged_at AS DATE) AS day, latency_ms AS v,
        floor(log2(CASE WHEN latency_ms = 0 THEN 1.0 ELSE abs(latency_ms) END)) AS g
    FROM generation_result WHERE latency_ms IS NOT NULL AND NOT isnan(latency_ms)),
y AS (SELECT model_id, day, v, CASE WHEN v <> 0 AND pow(2.0, g) > abs(v) THEN g - 1 WHEN v <> 0 AND pow(2.0, g + 1) <= abs(v) THEN g + 1 ELSE g END AS e FROM x),
c AS (SELECT model_id, day, {_BUCKET} AS bucket, count(*) AS n, min(v) AS low, max(v) AS high FROM y GROUP BY 1, 2, 3),
s AS (SELECT model_id, 'day' AS scope, day, bucket, n, low, high FROM c
    UNION ALL SELECT model_id, 'all', CAST(NULL AS DATE), bucket, sum(n), min(low), max(high) FROM c GROUP BY model_id, bucket),
r AS (SELECT *, sum(n) OVER (PARTITION BY model_id, scope, day ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS running,
        sum(n) OVER (PARTITION BY model_id, scope, day) AS n_values FROM s),
p AS (SELECT unnest([0.5, 0.9, 0.95, 0.99])::DOUBLE AS percentile)
SELECT model_id, scope, day, percentile, CASE WHEN low = high THEN low ELSE (low + high) / 2 END AS value, low, high, CAST(n_values AS BIGINT) AS n_values
FROM r, p WHERE running >= greatest(1, ceil(percentile * n_values)) AND running - n < greatest(1, ceil(percentile * n_values))
"""

_WORDS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'))"
_SQL_KEY = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}<>=!+\-*/%]+', '', 'g')"
_LEVEL = "translate(lower(trim({})), '- ', '__')"

_P1 = f"""
WITH RECURSIVE c AS (SELECT DISTINCT db_id, {_LEVEL.format("db_id")} AS k, lower(trim(author)) AS au, lower(trim(origin)) AS og FROM db_catalog WHERE db_id IS NOT NULL),
t AS (SELECT k, 'a:' || au AS tie FROM c WHERE au NOT IN ('', 'unknown', 'n/a') UNION SELECT k, 'o:' || og FROM c WHERE og NOT IN ('', 'unknown', 'n/a')),
e AS (SELECT DISTINCT x.k AS a, y.k AS b FROM t x JOIN t y USING (tie)),
reach(a, b) AS (SELECT k, k FROM c UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
g AS (SELECT a AS k, min(b) AS root FROM reach GROUP BY a),
s AS (SELECT DISTINCT {_LEVEL.format("db_id")} AS k, lower(trim(split)) AS split FROM train_contaminated WHERE split IS NOT NULL AND db_id IS NOT NULL),
torn AS (SELECT root FROM s JOIN g USING (k) GROUP BY root HAVING count(DISTINCT split) > 1)
SELECT DISTINCT c.db_id FROM c JOIN g USING (k) JOIN torn USING (root) WHERE c.k IN (SELECT k FROM s)
"""

_P6 = f"""
WITH raw AS (SELECT json_extract_string(payload, '$.example_id') AS example_id, json_extract_string(payload, '$.question') AS question, json_extract_string(payload, '$.gold_sql') AS gold_sql
    FROM mock_spider_raw WHERE json_valid(payload)),
x AS (SELECT example_id, question, gold_sql FROM mock_spider UNION ALL SELECT * FROM raw),
k AS (SELECT example_id, regexp_replace(lower(coalesce(question, '')), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS q, {_SQL_KEY.format("coalesce(gold_sql, '')")} AS s FROM x)
SELECT min(example_id) AS example_id, count(*) AS n_copies FROM k GROUP BY q, s HAVING count(*) > 1
"""

_P7 = """
SELECT example_id, question, db_id FROM mock_spider
WHERE CAST('0x' || substr(md5('corvane-sample-1:' || coalesce('k' || example_id, 'null')), 1, 13) AS BIGINT) / 4503599627370496.0 < 0.1
"""

_P8 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_passage),
di AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k+11], ' '))) AS g FROM d WHERE len(w) >= 12),
ii AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k+11], ' '))) AS g FROM i WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM di JOIN ii USING (g)
"""


def oracle_sql() -> dict[str, str]:
    """SQL over whole tables. The pair searches (p2, p5) have none: whole tables are too slow there in plain SQL;
    they are tested against brute force on a small fixture, as are p4, p9 and p10."""
    return {"p1_found": _P1, "p3_latency": _P3, "p6_found": _P6, "p7_sample": _P7, "p8_found": _P8}
