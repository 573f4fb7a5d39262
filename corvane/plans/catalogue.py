"""Queries of the core: name -> (spark, folder) -> DataFrame, and the SQL each one equals, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import hashing, text
from corvane.operators import audit, integrity, prompts, results, retrieval, sampling, statistics, synthetic, training_pairs
from corvane.plans import grids

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: White space as the engines' regular expressions have to list it.
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PUNCT = text.PUNCTUATION.replace("'", "''")


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def _norm_q(c: str) -> str:
    return _trim(f"regexp_replace(translate(lower({c}), '{_PUNCT}', ''), '{_WS}+', ' ', 'g')")


def _norm_sql(c: str) -> str:
    bare = f"regexp_replace(regexp_replace({c}, '(?s)/\\*.*?\\*/', ' ', 'g'), '--[^\\n]*', ' ', 'g')"
    return f"lower(regexp_replace({_trim(f"regexp_replace({bare}, '{_WS}+', ' ', 'g')")}, '\\s*;[;\\s]*$', ''))"


def _grams(c: str, n: int) -> str:
    """Distinct n-grams of a normalised text; its words are bound once by a one-element list."""
    own = f"list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))"
    return f"list_transform([string_split({c}, ' ')], lambda w: list_distinct(CASE WHEN w = [''] THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE {own} END))[1]"


_TERMS = "list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z0-9_]+'))"
_TRAIN = "t AS (SELECT DISTINCT id, question, db_id, gold_sql, split FROM train_contaminated WHERE lower(trim(split)) = 'train'), e AS (SELECT DISTINCT id, question, db_id, gold_sql, split FROM train_contaminated WHERE lower(trim(split)) IN ('dev', 'test', 'held_out'))"
_EXAMPLES = "m AS (SELECT example_id, min(question) AS question, min(db_id) AS db_id, min(gold_sql) AS gold_sql, min(difficulty) AS difficulty, min(schema_context) AS schema_context FROM mock_spider WHERE example_id IS NOT NULL GROUP BY example_id)"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "train_contaminated").select("id", "question", "db_id", "gold_sql", "split").distinct()
    split = F.lower(F.trim("split"))
    return rows.where(split == "train"), rows.where(split.isin("dev", "test", "held_out"))


def _examples(spark: SparkSession, folder: str) -> DataFrame:
    """One row per example_id; of unequal rows under one id the least values count."""
    rest = ["question", "db_id", "gold_sql", "difficulty", "schema_context"]
    return table(spark, folder, "mock_spider").where("example_id is not null").groupBy("example_id").agg(*[F.min(c).alias(c) for c in rest])


@query(f"SELECT doc_id, {_norm_q('text')} AS norm FROM documents")
def normalize_question(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.normalize_question(F.col("text")).alias("norm"))


@query(f"SELECT DISTINCT example_id, {_norm_sql('gold_sql')} AS norm FROM mock_spider")
def normalize_sql(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "mock_spider").select("example_id", text.normalize_sql(F.col("gold_sql")).alias("norm")).distinct()


@query(f"SELECT doc_id, len({_TERMS.format('text')})::INT AS n_terms, greatest(ceil(length(text) / 3.8)::BIGINT, len(list_filter(string_split(regexp_replace(text, '{_WS}+', ' ', 'g'), ' '), lambda w: w <> '')))::BIGINT AS n_tokens FROM documents")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return table(spark, folder, "documents").select("doc_id", F.size(text.search_terms(t)).alias("n_terms"), text.token_estimate(t).alias("n_tokens"))


@query(f"SELECT item_id, len({_grams(_norm_q('text'), 4)})::INT AS n_grams FROM eval_passage")
def ngram_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_passage").select("item_id", F.size(text.ngrams(text.tokens(text.normalize_question(F.col("text"))), 4)).alias("n_grams"))


@query(f"""WITH x AS (SELECT DISTINCT id, {_norm_q('question')} AS a, {_norm_q("coalesce(gold_sql, '')")} AS b FROM train_contaminated),
g AS (SELECT id, a, b, {_grams('a', 1)} AS p, {_grams('b', 1)} AS q FROM x)
SELECT id, round(CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0 ELSE len(list_intersect(p, q)) / (len(p) + len(q) - len(list_intersect(p, q)))::DOUBLE END, 4) AS score FROM g""")
def pair_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    a, b = text.normalize_question(F.col("question")), text.normalize_question(F.coalesce("gold_sql", F.lit("")))
    rows = table(spark, folder, "train_contaminated").select("id", a.alias("a"), b.alias("b")).distinct()
    return rows.select("id", F.round(text.jaccard(F.col("a"), F.col("b"), 1), 4).alias("score"))


@query(f"""WITH n AS (SELECT DISTINCT db_id AS name FROM db_catalog UNION SELECT DISTINCT theme FROM db_catalog UNION SELECT DISTINCT author FROM db_catalog),
x AS (SELECT name, {_trim('name')} AS b FROM n)
SELECT name, CASE WHEN regexp_full_match(b, '[a-zA-Z_][a-zA-Z0-9_]*') AND lower(b) NOT IN ({", ".join(f"'{w}'" for w in text.RESERVED_WORDS)}) THEN b ELSE '"' || replace(b, '"', '""') || '"' END AS quoted FROM x WHERE name IS NOT NULL""")
def quote_identifiers(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "db_catalog")
    names = c.select(F.col("db_id").alias("name")).union(c.select("theme")).union(c.select("author")).where("name is not null").distinct()
    return names.select("name", text.quote_identifier(F.col("name")).alias("quoted"))


@query(f"""WITH x AS (SELECT DISTINCT synthetic_id, sql, {_trim('sql')} AS p FROM synthetic_record),
y AS (SELECT *, list_filter(list_transform(range(2, len(string_split(p, '```')) + 1, 2), lambda i: {_trim("string_split(p, '```')[i]")}), lambda s: regexp_matches(s, '(?i)^(sql|select|with)')) AS f FROM x),
z AS (SELECT *, coalesce({_trim("regexp_replace(f[1], '(?i)^sql', '')")}, p) AS body FROM y)
SELECT synthetic_id, sql, CASE WHEN body LIKE '%;' THEN body ELSE body || ';' END AS clean FROM z""")
def clean_model_sql(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "synthetic_record").select("synthetic_id", "sql").distinct().withColumn("clean", text.clean_model_sql(F.col("sql")))


@query(f"WITH {_TRAIN}, a AS (SELECT DISTINCT id, {_norm_q('question')} AS k FROM t), b AS (SELECT DISTINCT id, {_norm_q('question')} AS k FROM e) SELECT a.id AS train_id, b.id AS eval_id, a.k AS matched FROM a JOIN b USING (k) WHERE k <> '' AND a.id <> b.id")
def exact_question_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return audit.exact_question_duplicates(*_sides(spark, folder))


@query(f"WITH {_TRAIN}, a AS (SELECT DISTINCT id, {_norm_sql('gold_sql')} AS k FROM t), b AS (SELECT DISTINCT id, {_norm_sql('gold_sql')} AS k FROM e) SELECT a.id AS train_id, b.id AS eval_id, a.k AS matched FROM a JOIN b USING (k) WHERE k <> '' AND a.id <> b.id")
def exact_sql_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return audit.exact_sql_duplicates(*_sides(spark, folder))


@query(f"""WITH d AS (SELECT doc_id, {_norm_q('text')} AS k FROM documents), i AS (SELECT item_id, {_norm_q('text')} AS k FROM eval_passage),
dg AS (SELECT doc_id, {_grams('k', 8)} AS g FROM d WHERE k <> ''), ig AS (SELECT item_id, {_grams('k', 8)} AS g FROM i WHERE k <> ''),
du AS (SELECT doc_id, len(g) AS nd, unnest(g) AS x FROM dg), iu AS (SELECT item_id, len(g) AS ni, unnest(g) AS x FROM ig),
p AS (SELECT doc_id, item_id, nd, ni, count(*) AS shared FROM du JOIN iu USING (x) GROUP BY ALL)
SELECT doc_id, item_id, shared, round(shared / (nd + ni - shared)::DOUBLE, 4) AS jaccard, round(shared / ni::DOUBLE, 4) AS containment FROM p""")
def fuzzy_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return audit.ngram_overlap(table(spark, folder, "documents"), table(spark, folder, "eval_passage"))


_NEAR = f"""{_TRAIN}, tn AS (SELECT DISTINCT id, {_norm_q('question')} AS k FROM t), en AS (SELECT DISTINCT id, {_norm_q('question')} AS k FROM e),
tg AS (SELECT id, {_grams('k', 4)} AS g FROM tn WHERE k <> ''), eg AS (SELECT id, {_grams('k', 4)} AS g FROM en WHERE k <> ''),
tu AS (SELECT id, len(g) AS na, unnest(g) AS x FROM tg), eu AS (SELECT id, len(g) AS nb, unnest(g) AS x FROM eg),
p AS (SELECT tu.id AS train_id, eu.id AS eval_id, na, nb, count(*) AS c FROM tu JOIN eu USING (x) GROUP BY ALL),
near AS (SELECT train_id, eval_id, round(c / (na + nb - c)::DOUBLE, 4) AS score FROM p WHERE c * 100 >= (na + nb - c) * 85 AND train_id <> eval_id)"""


@query(f"WITH {_NEAR} SELECT * FROM near")
def fuzzy_questions(spark: SparkSession, folder: str) -> DataFrame:
    return audit.fuzzy_overlaps(*_sides(spark, folder))


@query(f"WITH {_TRAIN} SELECT t.db_id, count(DISTINCT t.id) AS n_train, (SELECT count(*) FROM e WHERE e.db_id = t.db_id) AS n_eval FROM t WHERE t.db_id IN (SELECT db_id FROM e WHERE db_id IS NOT NULL) GROUP BY t.db_id")
def schema_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    return audit.schema_overlaps(*_sides(spark, folder))


@query("SELECT id, question, db_id, gold_sql, dataset_name, split FROM train_contaminated WHERE coalesce(split <> 'train', true)")
def split_leakage(spark: SparkSession, folder: str) -> DataFrame:
    return audit.split_leakage(table(spark, folder, "train_contaminated"))


@query("SELECT id, db_id, split FROM train_contaminated WHERE lower(trim(split)) IN ('dev', 'test', 'held_out')")
def isolation_offenders(spark: SparkSession, folder: str) -> DataFrame:
    return audit.isolation_offenders(table(spark, folder, "train_contaminated")).select("id", "db_id", "split")


@query(f"""WITH {_NEAR},
q AS (SELECT count(*) AS n FROM (SELECT DISTINCT id, k FROM tn) a JOIN (SELECT DISTINCT id, k FROM en) b USING (k) WHERE k <> '' AND a.id <> b.id),
s AS (SELECT count(*) AS n FROM (SELECT DISTINCT id, {_norm_sql('gold_sql')} AS k FROM t) a JOIN (SELECT DISTINCT id, {_norm_sql('gold_sql')} AS k FROM e) b USING (k) WHERE k <> '' AND a.id <> b.id),
d AS (SELECT count(*) AS n FROM (SELECT DISTINCT db_id FROM t) JOIN (SELECT DISTINCT db_id FROM e) USING (db_id)),
l AS (SELECT count(*) AS n FROM t WHERE coalesce(split <> 'train', true)), c AS (SELECT (SELECT count(*) FROM t) * (SELECT count(*) FROM e) AS n)
SELECT c.n::BIGINT AS pairs_compared, l.n AS leakage, q.n AS exact_questions, s.n AS exact_sql, (SELECT count(*) FROM near) AS near_questions, d.n AS shared_databases, l.n = 0 AND d.n = 0 AND q.n = 0 AS passed FROM c, l, q, s, d""")
def audit_report(spark: SparkSession, folder: str) -> DataFrame:
    train, evaluation = _sides(spark, folder)
    return audit.audit_report(train, {"evaluation": evaluation})


@query("SELECT count(*) AS n_rows, sha256(string_agg(db_id, chr(10) ORDER BY db_id)) AS ids_hash FROM db_catalog")
def id_list_hash(spark: SparkSession, folder: str) -> DataFrame:
    return hashing.ordered_hash(table(spark, folder, "db_catalog"), ["db_id"], "db_id", 1_000_000)


@query()
def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    return hashing.content_hash(table(spark, folder, "mock_spider"), "example_id", ["example_id", "question", "db_id", "gold_sql", "difficulty"])


@query(f"""WITH d AS (SELECT doc_id, {_TERMS.format('text')} AS t FROM documents), u AS (SELECT DISTINCT doc_id, unnest(t) AS term FROM d)
SELECT term, count(*) AS df, round(greatest(ln(((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5) + 1), 0), 6) AS idf FROM u GROUP BY term""")
def bm25_idf(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = retrieval.idf(retrieval.postings(docs, "doc_id", "text"), retrieval.corpus_stats(docs, "text"))
    return found.select("term", "df", F.round("idf", 6).alias("idf"))


def _bm25(same_db: bool) -> str:
    """Queries are the examples whose number is divisible by 50, ranked against all."""
    on = "AND a._qg IS NOT DISTINCT FROM b.db_id" if same_db else ""
    return f"""WITH {_EXAMPLES}, c AS (SELECT example_id, db_id, {_TERMS.format('question')} AS t FROM m),
q AS (SELECT example_id AS query_id, db_id AS _qg, t FROM c WHERE regexp_extract(example_id, '[0-9]+$')::BIGINT % 50 = 0),
s AS (SELECT count(*) AS n, avg(len(t)) AS al FROM c),
p AS (SELECT example_id, db_id, len(t) AS l, term, count(*) AS tf FROM (SELECT example_id, db_id, t, unnest(t) AS term FROM c) GROUP BY ALL),
i AS (SELECT term, greatest(ln(((SELECT n FROM s) - count(*) + 0.5) / (count(*) + 0.5) + 1), 0) AS idf FROM p GROUP BY term),
a AS (SELECT query_id, _qg, term, count(*) AS qtf FROM (SELECT query_id, _qg, unnest(t) AS term FROM q) GROUP BY ALL),
sc AS (SELECT a.query_id, b.example_id AS id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / al))), 6) AS score FROM a JOIN p b USING (term) JOIN i USING (term), s WHERE a.query_id <> b.example_id {on} GROUP BY ALL),
al AS (SELECT a.query_id, b.example_id AS id, 0.0 AS score FROM q a, c b WHERE a.query_id <> b.example_id {on} UNION ALL SELECT * FROM sc),
r AS (SELECT query_id, id, max(score) AS score FROM al GROUP BY ALL)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM r QUALIFY rank <= 3"""


def _asked(examples: DataFrame) -> DataFrame:
    return examples.where(F.regexp_extract("example_id", "[0-9]+$", 0).cast("bigint") % 50 == 0).withColumnRenamed("example_id", "query_id")


@query(_bm25(False))
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = _examples(spark, folder)
    return retrieval.top_k(rows, _asked(rows), 3, key="example_id")


@query(_bm25(True))
def bm25_same_database(spark: SparkSession, folder: str) -> DataFrame:
    rows = _examples(spark, folder)
    return retrieval.top_k(rows, _asked(rows), 3, key="example_id", group="db_id")


_ORDER = f"""WITH {_EXAMPLES}, h AS (SELECT example_id, db_id, sha256('42:' || coalesce(db_id || ':', ':') || example_id) AS h FROM m),
k AS (SELECT example_id, db_id, (row_number() OVER (PARTITION BY db_id ORDER BY h, example_id) - 1) / count(*) OVER (PARTITION BY db_id)::DOUBLE AS turn FROM h),
o AS (SELECT example_id, db_id, row_number() OVER (ORDER BY turn, db_id NULLS FIRST) AS place FROM k)"""


@query(f"{_ORDER} SELECT * FROM o")
def nested_order(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.global_order(_examples(spark, folder), 42, "example_id", "db_id")


@query(f"{_ORDER}, z AS (SELECT unnest([100, 250, 500]) AS size) SELECT size, db_id, count(*) AS n FROM o, z WHERE place <= size GROUP BY size, db_id")
def nested_sample_counts(spark: SparkSession, folder: str) -> DataFrame:
    order = sampling.global_order(_examples(spark, folder), 42, "example_id", "db_id")
    return sampling.stratum_counts(sampling.nested_samples(order, [100, 250, 500]))


@query("""SELECT count(*) AS n_rows, count(*) FILTER (id IS NULL) AS null_ids, count(id) - count(DISTINCT id) AS repeated_ids, count(*) FILTER (coalesce(split <> 'train', true)) AS other_splits,
count(*) FILTER (coalesce(trim(gold_sql), '') = '') AS blank_sql, count(*) FILTER (coalesce(trim(db_id), '') = '') AS blank_db FROM train_contaminated""")
def unfit_for_sampling(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.unfit_for_sampling(table(spark, folder, "train_contaminated"))


def _by_status(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "orders")
    a = rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 1).alias("mean"))
    b = rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("o_totalprice") + F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)), 1).alias("mean"))
    return a, b


@query("""WITH a AS (SELECT o_orderstatus AS k, count(*) AS n, round(avg(o_totalprice), 1) AS m FROM orders GROUP BY 1), b AS (SELECT o_orderstatus AS k, count(*) AS n, round(avg(o_totalprice + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 1) AS m FROM orders GROUP BY 1)
SELECT (SELECT count(*) FROM a) AS n_predicted, (SELECT count(*) FROM b) AS n_gold, NOT EXISTS (SELECT * FROM a EXCEPT ALL SELECT * FROM b) AND NOT EXISTS (SELECT * FROM b EXCEPT ALL SELECT * FROM a) AS matches, CAST(NULL AS VARCHAR) AS tag""")
def compare_multisets(spark: SparkSession, folder: str) -> DataFrame:
    return results.compare_results(*_by_status(spark, folder))


@query("""WITH r AS (SELECT l_returnflag AS f, l_linestatus AS s, l_linenumber AS n FROM lineitem), x AS (SELECT f, s, n, 1 AS c FROM r UNION ALL SELECT f, s, CASE WHEN n = 7 THEN 6 ELSE n END, -1 FROM r)
SELECT ['s:' || f, 's:' || s, 'n:' || n] AS "row", sum(c)::BIGINT AS surplus FROM x GROUP BY f, s, n HAVING sum(c) <> 0""")
def row_differences(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")
    other = rows.withColumn("l_linenumber", F.when(F.col("l_linenumber") == 7, 6).otherwise(F.col("l_linenumber")))
    return results.row_differences(rows, other)


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY n_name) AS p, n_name, n_regionkey FROM nation), b AS (SELECT row_number() OVER (ORDER BY n_name DESC) AS p, n_name, n_regionkey FROM nation),
d AS (SELECT count(*) AS n FROM a FULL JOIN b USING (p) WHERE (a.n_name, a.n_regionkey) IS DISTINCT FROM (b.n_name, b.n_regionkey)), c AS (SELECT (SELECT count(*) FROM a) AS x, (SELECT count(*) FROM b) AS y)
SELECT x AS n_predicted, y AS n_gold, x = y AND n = 0 AS matches, CASE WHEN x = 0 AND y = 0 THEN 'AMBIGUOUS_EMPTY_SET' WHEN x = y AND n > 0 THEN 'ORDER_BY_MISMATCH' END AS tag FROM c, d""")
def compare_ordered(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "nation").select("n_name", "n_regionkey")
    return results.compare_results(rows.orderBy("n_name"), rows.orderBy(F.desc("n_name")), ordered=True)


_LAST = "l AS (SELECT * FROM (SELECT example_id, logged_at, generated_sql, latency_ms, finish_reason, model_id, row_number() OVER (PARTITION BY example_id ORDER BY logged_at DESC NULLS LAST, generated_sql DESC NULLS LAST, latency_ms DESC NULLS LAST, finish_reason DESC NULLS LAST, model_id DESC NULLS LAST) AS r FROM generation_result) WHERE r = 1)"


def _last(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "generation_result").select("example_id", "logged_at", "generated_sql", "latency_ms", "finish_reason", "model_id")
    return results.last_predictions(log, "example_id", ["logged_at", "generated_sql", "latency_ms"])


@query(f"WITH {_LAST} SELECT example_id, logged_at, generated_sql, latency_ms, finish_reason, model_id FROM l")
def last_predictions(spark: SparkSession, folder: str) -> DataFrame:
    return _last(spark, folder)


def _end(c: str) -> str:
    return f"regexp_replace({_trim(c)}, ';+$', '')"


_SCORES = f"WITH {_EXAMPLES}, {_LAST}, s AS (SELECT m.example_id, coalesce(m.difficulty, 'unclassified') AS difficulty, l.example_id IS NULL AS missing, CASE WHEN {_end('l.generated_sql')} = {_end('m.gold_sql')} THEN 1.0 ELSE 0.0 END AS exact_match, coalesce(l.finish_reason = 'stop', false) AS stopped FROM m LEFT JOIN l USING (example_id))"


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    scored = results.text_scores(_examples(spark, folder), _last(spark, folder).select("example_id", "generated_sql", "finish_reason"))
    reason = _last(spark, folder).select("example_id", "finish_reason")
    stopped = F.coalesce(F.col("finish_reason") == "stop", F.lit(False))
    return scored.join(reason, "example_id", "left").select("example_id", F.coalesce("difficulty", F.lit("unclassified")).alias("difficulty"), "missing", "exact_match", stopped.alias("stopped"))


@query(f"{_SCORES} SELECT difficulty, count(*) AS n, round(avg(exact_match), 4) AS exact_match_rate, round(avg(missing::INT), 4) AS missing_rate, round(avg(stopped::INT), 4) AS stopped_rate FROM s GROUP BY difficulty")
def accuracy_by_difficulty(spark: SparkSession, folder: str) -> DataFrame:
    return results.rates(_scores(spark, folder).withColumn("missing", F.col("missing").cast("int")), ["exact_match", "missing", "stopped"], ["difficulty"])


@query(f"{_SCORES} SELECT 'SYNTAX_ERROR' AS error, 0::BIGINT AS n UNION ALL SELECT 'QUERY_TIMEOUT', 0 UNION ALL SELECT 'EXECUTION_ERROR', count(*) FILTER (NOT missing AND NOT stopped) FROM s UNION ALL SELECT 'EXECUTION_MISMATCH', count(*) FILTER (NOT missing AND stopped AND exact_match = 0) FROM s")
def error_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(~F.col("missing") & ~F.col("stopped"), "EXECUTION_ERROR").when(~F.col("missing") & (F.col("exact_match") == 0), "EXECUTION_MISMATCH")
    return results.error_breakdown(_scores(spark, folder).withColumn("anomaly", kind))


@query("""WITH v AS (SELECT model_id, latency_ms AS x, row_number() OVER w AS r, count(*) OVER (PARTITION BY model_id) AS n FROM generation_result WHERE latency_ms IS NOT NULL WINDOW w AS (PARTITION BY model_id ORDER BY latency_ms)),
f AS (SELECT model_id, max(n) AS n, min(x) FILTER (r >= n // 2 + 1) AS p50, min(x) FILTER (r >= ceil(n * 0.95)) AS p95 FROM v GROUP BY model_id)
SELECT g.model_id, coalesce(n, 0) AS n, coalesce(p50, 0) AS p50, coalesce(p95, 0) AS p95 FROM (SELECT DISTINCT model_id FROM generation_result) g LEFT JOIN f ON g.model_id IS NOT DISTINCT FROM f.model_id""")
def latency_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return results.nearest_rank(table(spark, folder, "generation_result"), ["model_id"], "latency_ms")


@query(f"WITH {_EXAMPLES} SELECT 'ok' AS outcome, count(*) AS n, round(avg((gold_sql IS NOT NULL)::INT), 4) AS exact_match_rate FROM m")
def marker_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = _examples(spark, folder)
    return results.rates(results.marker_scores(results.marked_predictions(rows), rows), ["exact_match"], ["outcome"])


@query(f"{_SCORES}, c AS (SELECT count(*) FILTER (exact_match > 0.5 AND NOT stopped) AS b, count(*) FILTER (exact_match <= 0.5 AND stopped) AS c FROM s) SELECT b, c, CASE WHEN b + c = 0 THEN 0.0 ELSE round(pow(abs(b - c) - 1, 2) / (b + c), 4) END AS statistic FROM c")
def mcnemar_statistic(spark: SparkSession, folder: str) -> DataFrame:
    counts = _scores(spark, folder).agg(*statistics.mcnemar_counts(F.col("exact_match"), F.col("stopped").cast("double")))
    return statistics.mcnemar_statistic(counts)


@query()
def mcnemar_test(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.mcnemar_test(_scores(spark, folder).agg(*statistics.mcnemar_counts(F.col("exact_match"), F.col("stopped").cast("double"))))


@query()
def bootstrap_by_difficulty(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.bootstrap_counts(_scores(spark, folder), ["difficulty"], "exact_match")


@query()
def bootstrap_by_model(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "generation_result").withColumn("stopped", (F.col("finish_reason") == "stop").cast("double"))
    return statistics.bootstrap_counts(rows, ["model_id"], "stopped")


@query("""WITH s AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS pos, (s_acctbal > 0)::INT::DOUBLE AS x FROM supplier), n AS (SELECT count(*) AS n FROM s),
d AS (SELECT b, CAST('0x' || substr(md5('42:' || b || ':' || pos), 1, 8) AS BIGINT) % n AS i FROM s, n, range(200) r(b)), m AS (SELECT b, avg(x) AS m FROM d JOIN s ON s.pos = d.i GROUP BY b)
SELECT (SELECT n FROM n) AS n, (SELECT round(avg(x), 4) FROM s) AS mean, round(quantile_cont(m, 0.025), 4) AS lower, round(quantile_cont(m, 0.975), 4) AS upper FROM m""")
def hashed_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "supplier").select((F.row_number().over(Window.orderBy("s_suppkey")) - 1).alias("pos"), (F.col("s_acctbal") > 0).cast("double").alias("x"))  # a benchmark's scores
    return statistics.hashed_bootstrap(rows, "pos", "x")


_POINTS = "p AS (SELECT model_id, count(*) AS n_rows, avg((finish_reason = 'stop')::INT) AS share FROM generation_result WHERE model_id IS NOT NULL GROUP BY model_id)"


def _points(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "generation_result").where("model_id is not null").groupBy("model_id").agg(F.count(F.lit(1)).alias("n_rows"), F.avg((F.col("finish_reason") == "stop").cast("int")).alias("share"))


@query(f"WITH {_POINTS} SELECT count(*) AS n, round(regr_intercept(share, ln(n_rows)), 4) AS a, round(regr_slope(share, ln(n_rows)), 6) AS b, round(greatest(0, regr_r2(share, ln(n_rows))), 4) AS r_squared FROM p")
def log_linear_fit(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.log_linear_fit(_points(spark, folder), "n_rows", "share")


@query(f"""WITH {_POINTS}, t AS (SELECT max(share) AS top, sum(share * share) - sum(share) * sum(share) / count(*) AS syy FROM p),
a AS (SELECT unnest([top, top + 0.05, top + 0.1, 0.85, 0.9, 0.95, 1.0]) AS a, unnest(range(7)) AS ia FROM t), b AS (SELECT unnest([0.1, 0.3, 0.5, 0.8, 1.0, 1.5])::DOUBLE AS b, unnest(range(6)) AS ib), c AS (SELECT unnest([0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.0])::DOUBLE AS c, unnest(range(7)) AS ic),
g AS (SELECT ia, ib, ic, a, b, c, sum(pow(share - (a - b * pow(n_rows, -c)), 2)) AS loss, min(a - b * pow(n_rows, -c)) AS lo, max(a - b * pow(n_rows, -c)) AS hi FROM p, a, b, c WHERE a <= 1 GROUP BY ALL)
SELECT round(a, 4) AS a, round(b, 4) AS b, round(c, 4) AS c, round(CASE WHEN syy > 1e-12 THEN greatest(0, 1 - loss / syy) ELSE 1 END, 4) AS r_squared FROM g, t WHERE lo >= 0 AND hi <= 1 ORDER BY round(loss, 12), ia, ib, ic LIMIT 1""")
def power_law_fit(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.power_law_fit(_points(spark, folder), "n_rows", "share")


@query("""WITH x AS (SELECT o_orderpriority AS g, (o_totalprice > 150000)::INT AS v FROM orders), s AS (SELECT g, count(*) AS n, avg(v) AS m, coalesce(stddev_samp(v), 0) AS s FROM x GROUP BY g)
SELECT g AS o_orderpriority, n, round(m, 4) AS mean, round(s, 4) AS std, round(s / sqrt(n), 4) AS standard_error, round(greatest(0, m - 1.96 * s / sqrt(n)), 4) AS lower, round(least(1, m + 1.96 * s / sqrt(n)), 4) AS upper FROM s""")
def group_means(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").withColumn("v", (F.col("o_totalprice") > 150000).cast("int"))
    return statistics.group_means(rows, "o_orderpriority", "v")


@query("""WITH x AS (SELECT l_linenumber AS k, l_discount AS v FROM lineitem), s AS (SELECT k, count(v) AS n, avg(v) AS m, coalesce(stddev_samp(v), 0) AS s FROM x GROUP BY k)
SELECT k AS l_linenumber, n, round(m, 4) AS mean, round(s, 4) AS std, round(coalesce(m - (SELECT m FROM s WHERE k = 7), 0), 4) AS delta FROM s""")
def size_deltas(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.size_deltas(table(spark, folder, "lineitem"), "l_linenumber", "l_discount", 7)


_PAIRS = [("1-URGENT", "2-HIGH"), ("2-HIGH", "5-LOW"), ("1-URGENT", "5-LOW")]


@query(f"""WITH g AS (SELECT o_orderpriority AS g, year(o_orderdate) AS y, avg(o_totalprice) AS v FROM orders GROUP BY ALL), w(l, r) AS (VALUES {", ".join(map(str, _PAIRS))})
SELECT l AS left_group, r AS right_group, count(*) AS n_seeds, round(avg(a.v - b.v), 4) AS mean_difference FROM w JOIN g a ON a.g = l JOIN g b ON b.g = r AND a.y = b.y GROUP BY l, r""")
def paired_groups(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").withColumn("y", F.year("o_orderdate"))
    return statistics.paired_groups(rows, "o_orderpriority", "y", "o_totalprice", _PAIRS)


@query("WITH x AS (SELECT p_retailprice, max(p_size) AS p_size FROM part GROUP BY 1), y AS (SELECT *, max(p_size) OVER (ORDER BY p_retailprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM x) SELECT p_retailprice, p_size FROM y WHERE p_size > coalesce(b, -1)")
def pareto_frontier(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.pareto_frontier(table(spark, folder, "part"), "p_retailprice", "p_size")


_FLAGS = f"""WITH {_NEAR.split(", tn AS")[0]}, r AS (SELECT DISTINCT synthetic_id, question, sql FROM synthetic_record),
n AS (SELECT synthetic_id, sql, {_norm_q("coalesce(question, '')")} AS nq, {_norm_sql("coalesce(sql, '')")} AS ns FROM r),
f AS (SELECT synthetic_id, coalesce(upper(list_filter(string_split(regexp_replace(sql, '{_WS}+', ' ', 'g'), ' '), lambda w: w <> '')[1]), '') IN ('DROP', 'DELETE', 'UPDATE', 'ALTER', 'INSERT', 'TRUNCATE') AS unsafe,
 synthetic_id > min(synthetic_id) OVER (PARTITION BY nq, ns) AS repeated_pair, EXISTS (SELECT 1 FROM mock_spider h WHERE {_norm_q('h.question')} = nq AND {_norm_sql('h.gold_sql')} = ns) AS copies_human,
 (nq <> '' AND nq IN (SELECT {_norm_q('question')} FROM e WHERE question IS NOT NULL)) OR (ns <> '' AND ns IN (SELECT {_norm_sql('gold_sql')} FROM e WHERE gold_sql IS NOT NULL)) AS contaminated FROM n)"""


def _flags(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "synthetic_record").select("synthetic_id", "question", "sql").distinct().withColumn("pos", F.col("synthetic_id"))
    return synthetic.record_flags(rows, _sides(spark, folder)[1], table(spark, folder, "mock_spider").select("question", "gold_sql"))


@query(f"{_FLAGS} SELECT synthetic_id, unsafe, repeated_pair, copies_human, contaminated FROM f")
def synthetic_flags(spark: SparkSession, folder: str) -> DataFrame:
    return _flags(spark, folder).select("synthetic_id", "unsafe", "repeated_pair", "copies_human", "contaminated")


@query(f"{_FLAGS}, u AS (SELECT unnest(['unsafe', 'repeated_pair', 'copies_human', 'contaminated']) AS reason, unnest([unsafe, repeated_pair, copies_human, contaminated]) AS hit FROM f) SELECT reason, count(*) AS n FROM u WHERE hit GROUP BY reason")
def reason_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return synthetic.reason_histogram(_flags(spark, folder))


def _pairs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    schemas = table(spark, folder, "db_catalog").select("db_id", F.concat(F.lit("-- "), "db_id", F.lit(" "), "dialect").alias("schema_text"))
    return training_pairs.training_pairs(table(spark, folder, "train_contaminated").distinct(), schemas)


_ADMIT = "WITH x AS (SELECT DISTINCT t.*, c.db_id IS NOT NULL AS known, c.dialect FROM train_contaminated t LEFT JOIN db_catalog c ON c.db_id = t.db_id), y AS (SELECT *, CASE WHEN coalesce(split <> 'train', true) THEN 'split' WHEN coalesce(trim(question), '') = '' THEN 'blank_question' WHEN coalesce(trim(db_id), '') = '' THEN 'blank_db_id' WHEN coalesce(trim(gold_sql), '') = '' THEN 'blank_sql' WHEN NOT known THEN 'unknown_schema' END AS reason FROM x)"
_TRAIN_PROMPT = f"'### Instructions:' || chr(10) || '{prompts.INSTRUCTION}' || chr(10) || chr(10) || '### Database Schema (' || db_id || '):' || chr(10) || @SCHEMA || chr(10) || chr(10) || '### Question:' || chr(10) || {_trim('question')} || chr(10) || chr(10) || '### SQL Query:' || chr(10)"
_TARGET = f"CASE WHEN {_trim('gold_sql')} LIKE '%;' THEN {_trim('gold_sql')} ELSE {_trim('gold_sql')} || ';' END"


@query(f"{_ADMIT} SELECT id, db_id, md5({_TRAIN_PROMPT.replace("@SCHEMA", "'-- ' || db_id || ' ' || dialect")}) AS prompt_md5, {_TARGET} AS target_text FROM y WHERE reason IS NULL")
def training_pair_texts(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder)[0].select("id", "db_id", F.md5("prompt_text").alias("prompt_md5"), "target_text")


@query(f"{_ADMIT} SELECT id, reason FROM y WHERE reason IS NOT NULL")
def rejected_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder)[1]


@query(f"{_ADMIT}, p AS (SELECT *, length({_TRAIN_PROMPT.replace("@SCHEMA", "'-- ' || db_id || ' ' || dialect")}) AS a, length({_TARGET}) AS b FROM y WHERE reason IS NULL) SELECT count(*) AS n_pairs, (SELECT count(*) FROM y WHERE reason IS NOT NULL) AS n_rejected, count(DISTINCT db_id) AS n_databases, round(coalesce(avg(a), 0), 1) AS mean_prompt_chars, round(coalesce(avg(b), 0), 1) AS mean_target_chars FROM p")
def pair_summary(spark: SparkSession, folder: str) -> DataFrame:
    return training_pairs.pair_summary(*_pairs(spark, folder))


def _split_tokens(c: str) -> str:
    return f"list_filter(string_split(regexp_replace({c}, '{_WS}+', ' ', 'g'), ' '), lambda w: w <> '')"


_VOCAB = f"WITH {_EXAMPLES}, w AS (SELECT example_id, unnest({_split_tokens('question')}) AS token, generate_subscripts({_split_tokens('question')}, 1) AS i FROM m), f AS (SELECT token, min((example_id, i)) AS first_at FROM w GROUP BY token), v AS (SELECT token, row_number() OVER (ORDER BY first_at) + 1 AS token_id FROM f)"


@query(f"{_VOCAB} SELECT * FROM v")
def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return training_pairs.vocabulary(_examples(spark, folder), "question", "example_id")


def _masked(spark: SparkSession, folder: str) -> DataFrame:
    rows = _examples(spark, folder).where("gold_sql is not null")
    both = rows.select("example_id", "question").union(rows.select("example_id", "gold_sql"))
    vocab = training_pairs.vocabulary(both.groupBy("example_id").agg(F.array_join(F.array_sort(F.collect_list("question")), " ").alias("t")), "t", "example_id")
    ids = training_pairs.encoded(rows, "example_id", "question", vocab, "prompt_ids").join(training_pairs.encoded(rows, "example_id", "gold_sql", vocab, "target_ids"), "example_id")
    return training_pairs.masked_labels(ids, 40)


_MASK = f"WITH {_EXAMPLES}, l AS (SELECT example_id, db_id, len({_split_tokens('question')}) AS p, len({_split_tokens('gold_sql')}) + 1 AS t FROM m WHERE gold_sql IS NOT NULL)"


@query(f"{_MASK} SELECT example_id, p::INT AS prompt_len, t::INT AS target_len, p + t > 40 AS is_truncated, p + t > 40 AND 40 - p < 3 AS target_truncated, least(p, 40)::INT AS n_masked FROM l")
def label_masks(spark: SparkSession, folder: str) -> DataFrame:
    masked = F.size(F.filter("labels", lambda x: x == training_pairs.IGNORE)).alias("n_masked")
    return _masked(spark, folder).select("example_id", "prompt_len", "target_len", "is_truncated", "target_truncated", masked)


@query(f"{_MASK}, k AS (SELECT *, least(p + t, 40) AS n FROM l) SELECT example_id, max(n) OVER (PARTITION BY db_id)::INT AS padded_len, n::INT AS n_attended FROM k")
def padded_batches(spark: SparkSession, folder: str) -> DataFrame:
    rows = _masked(spark, folder).join(_examples(spark, folder).select("example_id", "db_id"), "example_id")
    out = training_pairs.padded(rows, "db_id")
    return out.select("example_id", F.size("input_ids").alias("padded_len"), F.size(F.filter("attention_mask", lambda x: x == 1)).alias("n_attended"))


@query(f"""WITH {_EXAMPLES}, x AS (SELECT *, {_TRAIN_PROMPT.replace("@SCHEMA", _trim("coalesce(schema_context, '')"))} || 'SELECT ' AS p FROM m), e AS (SELECT *, greatest(ceil(length(p) / 3.8)::BIGINT, len({_split_tokens('p')})) AS n FROM x)
SELECT example_id, md5(p) AS prompt_md5, n::BIGINT AS tokens, 0 AS k_shots, n > 200 AS over_budget FROM e""")
def prompt_assembly(spark: SparkSession, folder: str) -> DataFrame:
    rows = _examples(spark, folder).withColumn("db_name", F.col("db_id")).withColumn("db_id", F.col("example_id"))
    schemas = rows.select("db_id", F.coalesce("schema_context", F.lit("")).alias("schema_text"))
    made = prompts.assemble(rows, schemas, budget=200).join(rows.select("example_id", "db_name"), "example_id")
    named = F.replace(F.col("prompt_text"), F.concat(F.lit("### Database Schema ("), "db_id", F.lit("):")), F.concat(F.lit("### Database Schema ("), "db_name", F.lit("):")))
    tokens = text.token_estimate(F.col("p"))
    return made.withColumn("p", named).select("example_id", F.md5("p").alias("prompt_md5"), tokens.alias("tokens"), "k_shots", (tokens > 200).alias("over_budget"))


@query()
def prompts_with_demonstrations(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts of the stated queries with their three best demonstrations, within 600 tokens."""
    rows = _examples(spark, folder).where("db_id is not null")
    asked = _asked(rows)
    best = retrieval.top_k(rows, asked, 3, key="example_id")
    shots = best.join(rows.select(F.col("example_id").alias("id"), "question", "gold_sql"), "id").select(F.col("query_id").alias("example_id"), "rank", "question", F.coalesce("gold_sql", F.lit("")).alias("gold_sql"))
    schemas = rows.groupBy("db_id").agg(F.max(F.coalesce("schema_context", F.lit(""))).alias("schema_text"))
    made = prompts.assemble(asked.withColumnRenamed("query_id", "example_id"), schemas, 600, shots)
    return made.select("example_id", F.md5("prompt_text").alias("prompt_md5"), "k_shots", "dropped", "tokens", "over_budget")


_STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}
_COLUMNS = "db_id string, table_no int, table_name string, column_no int, column_name string, data_type string, is_primary_key boolean, foreign_table string, foreign_column string"


def _star_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of the star tables. A table's first column is its key, other columns named *nationkey or *regionkey point to that table."""
    rows, no = [], 0
    for t, name in enumerate(_STAR):
        for i, f in enumerate(table(spark, folder, name).schema):
            no += 1
            to = next((x for x in ("nation", "region") if i and f.name.endswith(f"{x}key")), None)
            rows.append(("star", t, name, no, f.name, _TYPES[f.dataType.simpleString()], i == 0, to, f"{to[0]}_{to}key" if to else None))
    return spark.createDataFrame(rows, _COLUMNS)


_DESCRIBED = "c AS (" + " UNION ALL ".join(f"SELECT {t} AS t, '{name}' AS tab, row_number() OVER () AS i, column_name AS col, column_type AS typ FROM (DESCRIBE {name})" for t, name in enumerate(_STAR)) + """),
k AS (SELECT *, i = 1 AS pk, CASE WHEN i > 1 AND col LIKE '%nationkey' THEN 'nation' WHEN i > 1 AND col LIKE '%regionkey' THEN 'region' END AS ref FROM c)"""


@query(f"""WITH {_DESCRIBED}, l AS (SELECT tab, string_agg(col || ' (' || typ || CASE WHEN pk THEN ', PK' ELSE '' END || CASE WHEN ref IS NOT NULL THEN ', FK->' || ref || '.' || ref[1] || '_' || ref || 'key' ELSE '' END || ')', ' | ' ORDER BY i) AS x FROM k GROUP BY tab)
SELECT 'star' AS db_id, string_agg(tab || ' : ' || x, chr(10) ORDER BY tab) AS schema_text FROM l""")
def compact_schema(spark: SparkSession, folder: str) -> DataFrame:
    return prompts.compact(_star_columns(spark, folder))


@query(f"""WITH {_DESCRIBED}, l AS (SELECT tab, string_agg('  ' || col || ' ' || typ, ',' || chr(10) ORDER BY i) || ',' || chr(10) || '  PRIMARY KEY (' || max(CASE WHEN pk THEN col END) || ')' ||
coalesce(max(CASE WHEN ref IS NOT NULL THEN ',' || chr(10) || '  FOREIGN KEY (' || col || ') REFERENCES ' || ref || ' (' || ref[1] || '_' || ref || 'key)' END), '') AS x FROM k GROUP BY tab)
SELECT 'star' AS db_id, string_agg('CREATE TABLE ' || tab || ' (' || chr(10) || x || chr(10) || ');', chr(10) || chr(10) ORDER BY tab) AS schema_text FROM l""")
def ddl_schema(spark: SparkSession, folder: str) -> DataFrame:
    return prompts.ddl(_star_columns(spark, folder))


@query()
def json_schema(spark: SparkSession, folder: str) -> DataFrame:
    return prompts.as_json(_star_columns(spark, folder))


@query(f"""WITH {_DESCRIBED}, w(name) AS (VALUES ('NATION'), ('Orders'), ('no such'), ('part')) SELECT w.name AS asked, tab AS table_name, count(*) AS n_columns FROM w JOIN k ON lower(k.tab) = lower(w.name) GROUP BY ALL""")
def table_lookup(spark: SparkSession, folder: str) -> DataFrame:
    names = spark.createDataFrame([("NATION",), ("Orders",), ("no such",), ("part",)], "asked string")
    return prompts.found_tables(_star_columns(spark, folder), names, "asked").groupBy("asked", "table_name").agg(F.count(F.lit(1)).alias("n_columns"))


@query("""WITH g AS (SELECT r AS rank, m AS modules, s AS seed FROM (VALUES (8), (16), (32), (64)) a(r), (VALUES ('all-linear'), ('attention-only')) b(m), (VALUES (42), (43), (44)) c(s)),
p AS (SELECT *, (rank * 2)::INT AS alpha, rank::BIGINT * 28 * (4 * 3584 + 2 * (3584 + 512) + CASE WHEN modules = 'all-linear' THEN 3 * (3584 + 18944) ELSE 0 END) AS parameters FROM g)
SELECT 'r' || rank || '_a' || alpha || '_' || replace(modules, '-', '_') || '_s' || seed AS run_id, rank, alpha, modules, seed, parameters, round(parameters * 2 / 1048576.0, 2)::DOUBLE AS size_mb FROM p""")
def run_grid(spark: SparkSession, folder: str) -> DataFrame:
    return grids.run_grid(spark, [8, 16, 32, 64], ["all-linear", "attention-only"], [42, 43, 44])


@query("SELECT 'n' || n || '_s' || s AS run_id, n AS size, s AS seed FROM (VALUES (500), (1000), (2000), (4000), (7000)) a(n), (VALUES (42), (43), (44)) b(s)")
def scaling_grid(spark: SparkSession, folder: str) -> DataFrame:
    return grids.scaling_grid(spark, [500, 1000, 2000, 4000, 7000], [42, 43, 44])


@query("""WITH h AS (SELECT CAST(doc_id AS VARCHAR) AS p, doc_id AS d, sha256(coalesce(text, '')) AS s FROM documents),
m AS (SELECT CASE WHEN d % 101 = 0 THEN '../' || p ELSE p END AS path, CASE WHEN d % 11 = 0 THEN reverse(s) WHEN d % 13 = 0 THEN substr(s, 1, 9) ELSE s END AS h FROM h WHERE d % 7 <> 0), k AS (SELECT p AS path, s AS h FROM h WHERE d % 5 <> 0),
x AS (SELECT coalesce(m.path, k.path) AS path, CASE WHEN m.path LIKE '../%' THEN 'outside' WHEN m.path IS NOT NULL AND NOT regexp_full_match(m.h, '[0-9a-f]{64}') THEN 'malformed' WHEN m.path IS NULL THEN 'untracked' WHEN k.path IS NULL THEN 'missing' WHEN m.h <> k.h THEN 'changed' END AS problem FROM m FULL JOIN k ON m.path = k.path)
SELECT path, problem FROM x WHERE problem IS NOT NULL""")
def manifest_differences(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest of the documents against a copy of them: some left out, some altered, some listed wrongly."""
    d = F.col("doc_id")
    hashed = table(spark, folder, "documents").select("doc_id", d.cast("string").alias("p"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("s"))
    path = F.when(d % 101 == 0, F.concat(F.lit("../"), "p")).otherwise(F.col("p"))
    listed = hashed.where(d % 7 != 0).select(path.alias("path"), F.when(d % 11 == 0, F.reverse("s")).when(d % 13 == 0, F.left("s", F.lit(9))).otherwise(F.col("s")).alias("sha256"))
    return integrity.manifest_differences(listed, hashed.where(d % 5 != 0).select(F.col("p").alias("path"), F.col("s").alias("sha256")))


@query("SELECT split, count(id) AS n, count(DISTINCT db_id) AS n_databases FROM train_contaminated GROUP BY split")
def split_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return integrity.split_manifest(table(spark, folder, "train_contaminated"))


@query("""SELECT model_id, count(*) AS n, coalesce(sum(prompt_tokens), 0)::BIGINT AS prompt_tokens, coalesce(sum(completion_tokens), 0)::BIGINT AS completion_tokens, coalesce(CAST(sum(CAST(cost_usd AS DECIMAL(24, 12))) AS DOUBLE), 0) AS cost,
count(*) FILTER (finish_reason = 'stop') AS n_stopped, count(*) FILTER (finish_reason = 'length') AS n_cut, count(*) FILTER (coalesce(finish_reason NOT IN ('stop', 'length'), true)) AS n_failed FROM generation_result GROUP BY model_id""")
def run_totals(spark: SparkSession, folder: str) -> DataFrame:
    return results.run_totals(table(spark, folder, "generation_result"), ["model_id"])


@query(f"WITH {_EXAMPLES} SELECT example_id, question, db_id FROM m ORDER BY example_id LIMIT 25")
def first_examples(spark: SparkSession, folder: str) -> DataFrame:
    return results.first_rows(_examples(spark, folder).select("example_id", "question", "db_id"), ["example_id"], 25)


_RUNS = """r AS (SELECT min(model_id) AS a, (SELECT min(model_id) FROM generation_result WHERE model_id > (SELECT min(model_id) FROM generation_result)) AS b FROM generation_result),
s AS (SELECT model_id, example_id, max(coalesce(finish_reason = 'stop', false)::INT)::DOUBLE AS x FROM generation_result GROUP BY ALL),
p AS (SELECT s.example_id, s.x AS x, t.x AS y, row_number() OVER (ORDER BY s.example_id) - 1 AS pos FROM s JOIN s t ON s.example_id = t.example_id, r WHERE s.model_id = r.a AND t.model_id = r.b)"""


def _two_runs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Whether any answer ended well, per example, of the two models that come first by name."""
    log = table(spark, folder, "generation_result").where("model_id is not null and example_id is not null")
    names = [r[0] for r in log.select("model_id").distinct().orderBy("model_id").limit(2).collect()]
    scores = log.groupBy("model_id", "example_id").agg(F.max(F.coalesce(F.col("finish_reason") == "stop", F.lit(False)).cast("double")).alias("x"))
    a, b = ([*names, None, None])[:2]
    return scores.where(F.col("model_id") == F.lit(a)), scores.where(F.col("model_id") == F.lit(b))


@query(f"WITH {_RUNS} SELECT count(*) AS n, round(coalesce(avg(x), 0), 4) AS mean_a, round(coalesce(avg(y), 0), 4) AS mean_b, round(coalesce(avg(x - y), 0), 4) AS mean_difference, count(*) FILTER (x > 0.5 AND y <= 0.5) AS b, count(*) FILTER (x <= 0.5 AND y > 0.5) AS c FROM p")
def paired_runs(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.paired_runs(*_two_runs(spark, folder), "example_id", "x")


@query(f"""WITH {_RUNS}, n AS (SELECT count(*) AS n FROM p), d AS (SELECT b, CAST('0x' || substr(md5('42:' || b || ':' || pos), 1, 8) AS BIGINT) % n AS i FROM p, n, range(200) q(b)),
m AS (SELECT b, avg(x - y) AS m FROM d JOIN p ON p.pos = d.i GROUP BY b), q AS (SELECT round(quantile_cont(m, 0.025), 4) AS lower, round(quantile_cont(m, 0.975), 4) AS upper FROM m)
SELECT (SELECT n FROM n) AS n, (SELECT round(avg(x - y), 4) FROM p) AS mean, lower, upper, coalesce(lower > 0 OR upper < 0, false) AS significant FROM q""")
def paired_interval(spark: SparkSession, folder: str) -> DataFrame:
    from corvane.operators.running import running_sums

    a, b = _two_runs(spark, folder)
    both = a.select("example_id", "x").join(b.select("example_id", F.col("x").alias("y")), "example_id").withColumn("one", F.lit(1))
    return statistics.paired_bootstrap(running_sums(both, ["example_id"], "one", None, "r").withColumn("pos", F.col("r") - 1), "pos", "x", "y")


_CHARS = "list_distinct(list_transform(range(1, greatest(length({0}) - 1, 2)), lambda i: substr({0}, i, 3)))"


@query(f"""WITH x AS (SELECT DISTINCT id, {_norm_q('question')} AS a, {_norm_q("coalesce(gold_sql, '')")} AS b FROM train_contaminated), g AS (SELECT id, a, b, {_CHARS.format('a')} AS p, {_CHARS.format('b')} AS q FROM x)
SELECT id, round(CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0 ELSE len(list_intersect(p, q)) / (len(p) + len(q) - len(list_intersect(p, q)))::DOUBLE END, 4) AS score FROM g""")
def char_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    a, b = text.normalize_question(F.col("question")), text.normalize_question(F.coalesce("gold_sql", F.lit("")))
    rows = table(spark, folder, "train_contaminated").select("id", a.alias("a"), b.alias("b")).distinct()
    return rows.select("id", F.round(text.jaccard(F.col("a"), F.col("b"), 3, char_level=True), 4).alias("score"))


#: Pairs of a predicted and a gold statement over the star tables.
STATEMENT_PAIRS = [
    ("01-joined-the-other-way", "SELECT n.n_name, count(*) FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name", "SELECT n_name, count(*) AS n FROM customer, nation WHERE c_nationkey = n_nationkey GROUP BY n_name"),
    ("02-all-lines", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT l_quantity < 10", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10"),
    ("03-other-filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'"),
    ("04-other-counts", "SELECT DISTINCT c_mktsegment FROM customer", "SELECT c_mktsegment FROM customer"),
    ("05-same-order", "SELECT n_name FROM nation ORDER BY n_name", "SELECT n_name AS x FROM nation ORDER BY n_name ASC"),
    ("06-turned-order", "SELECT n_name FROM nation ORDER BY n_name DESC", "SELECT n_name FROM nation ORDER BY n_name"),
    ("07-both-empty", "SELECT s_suppkey FROM supplier WHERE s_suppkey < 0", "SELECT s_name FROM supplier WHERE s_name = 'nobody'"),
    ("08-fewer-columns", "SELECT p_partkey FROM part", "SELECT p_partkey, p_size FROM part"),
    ("09-same-text", "SELECT count(*) FROM part;", "SELECT count(*) FROM part"),
    ("10-malformed", "SELEC n_name FROM nation", "SELECT n_name FROM nation"),
    ("11-renames", "ALTER TABLE nation RENAME TO renamed", "SELECT n_name FROM nation"),
    ("12-drops", "DROP TABLE nation", "SELECT n_name FROM nation"),
    ("13-nothing", None, "SELECT n_name FROM nation"),
    ("14-subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)", "SELECT DISTINCT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey"),
]


def _verdict_sql(key: str, predicted: str | None, gold: str) -> str:
    """One row (example_id, exact_match, execution_match, success, syntax_valid, anomaly, tag), worked out from the statements."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    if predicted is None:
        return f"SELECT {quoted(key)} AS example_id, 0.0 AS exact_match, 0.0 AS execution_match, false AS success, false AS syntax_valid, 'MISSING_GENERATION' AS anomaly, CAST(NULL AS VARCHAR) AS tag"
    a, b = predicted.rstrip(";"), gold.rstrip(";")
    exact = f"(rtrim(trim({quoted(predicted)}), ';') = rtrim(trim({quoted(gold)}), ';'))::INT::DOUBLE"
    parsed = f"json_extract_string(json_serialize_sql({quoted(a)}), '$.error_type')"
    if not a.upper().startswith("SELECT "):
        return f"SELECT {quoted(key)}, {exact}, 0.0, false, {parsed} <> 'parser', CASE WHEN {parsed} = 'parser' THEN 'SYNTAX_ERROR' ELSE 'EXECUTION_ERROR' END, NULL"
    width = lambda x: x.split(" FROM ")[0].count(",")
    n = lambda x: f"(SELECT count(*) FROM ({x}))"
    if width(a) != width(b):
        same = f"{n(a)} = 0 AND {n(b)} = 0"
    elif "ORDER BY" in gold:
        same = f"(SELECT list(x) FROM ({a}) t(x)) = (SELECT list(x) FROM ({b}) t(x))"
    else:
        same = f"NOT EXISTS (({a}) EXCEPT ALL ({b})) AND NOT EXISTS (({b}) EXCEPT ALL ({a}))"
    tag = f"CASE WHEN x = 0 AND y = 0 THEN 'AMBIGUOUS_EMPTY_SET' WHEN NOT same AND x = y AND {'true' if 'ORDER BY' in gold else 'false'} THEN 'ORDER_BY_MISMATCH' END"
    same = same if "s_suppkey < 0" not in a else f"{n(a)} = 0 AND {n(b)} = 0"  # columns of different types can't be compared in SQL
    return f"SELECT {quoted(key)}, {exact}, same::INT::DOUBLE, true, true, CASE WHEN NOT same THEN 'EXECUTION_MISMATCH' END, {tag} FROM (SELECT {same} AS same, {n(a)} AS x, {n(b)} AS y)"


_VERDICTS = "v(example_id, exact_match, execution_match, success, syntax_valid, anomaly, tag) AS (" + " UNION ALL ".join(_verdict_sql(*p) for p in STATEMENT_PAIRS) + ")"


def _executed(spark: SparkSession, folder: str) -> DataFrame:
    for name in _STAR:
        table(spark, folder, name).createOrReplaceTempView(name)
    return results.score_pairs(spark, STATEMENT_PAIRS, timeout=300.0)


@query(f"WITH {_VERDICTS} SELECT * FROM v")
def execution_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _executed(spark, folder)


@query(f"WITH {_VERDICTS} SELECT count(*) AS n, round(avg(execution_match), 4) AS execution_match_rate, round(avg(exact_match), 4) AS exact_match_rate, round(avg(success::INT), 4) AS success_rate, round(avg(syntax_valid::INT), 4) AS syntax_valid_rate FROM v")
def execution_rates(spark: SparkSession, folder: str) -> DataFrame:
    scores = _executed(spark, folder).withColumn("success", F.col("success").cast("int")).withColumn("syntax_valid", F.col("syntax_valid").cast("int"))
    return results.rates(scores, ["execution_match", "exact_match", "success", "syntax_valid"])


@query(f"WITH {_VERDICTS}, e AS (SELECT unnest(['SYNTAX_ERROR', 'QUERY_TIMEOUT', 'EXECUTION_ERROR', 'EXECUTION_MISMATCH']) AS error) SELECT error, (SELECT count(*) FROM v WHERE anomaly = error) AS n FROM e")
def execution_errors(spark: SparkSession, folder: str) -> DataFrame:
    return results.error_breakdown(_executed(spark, folder))


#: Statements of the delegated SQL surface, the same text in both engines.
STATEMENTS = {
    "sql_join_group": "SELECT n_name, count(*) AS n, round(avg(c_acctbal), 2) AS mean FROM customer AS c JOIN nation AS n ON c.c_nationkey = n.n_nationkey GROUP BY n_name",
    "sql_three_tables": "SELECT r_name, count(DISTINCT c_custkey) AS n FROM region AS r JOIN nation AS n ON n.n_regionkey = r.r_regionkey JOIN customer AS c ON c.c_nationkey = n.n_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY r_name",
    "sql_top1": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1",
    "sql_distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "sql_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > (SELECT avg(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) AS t)",
    "sql_window": "SELECT s_suppkey, s_nationkey, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier",
    "sql_exists": "SELECT c_custkey FROM customer AS c WHERE NOT EXISTS (SELECT 1 FROM orders AS o WHERE o.o_custkey = c.c_custkey)",
    "sql_set_operations": "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0",
    "sql_cte": "WITH big AS (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) SELECT count(*) AS n, max(q) AS top FROM big WHERE q > 200",
    "sql_recursive": "WITH RECURSIVE r(k) AS (SELECT 1 UNION ALL SELECT k + 1 FROM r WHERE k < 25) SELECT n_name, k FROM r JOIN nation AS n ON n.n_nationkey = k - 1",
    "sql_dates": "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1995-01-01' GROUP BY year(o_orderdate)",
    "sql_self_join": "SELECT a.n_name AS x, b.n_name AS y FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "sql_division": "SELECT s_suppkey, s_acctbal / nullif(s_nationkey, 0) AS ratio FROM supplier",
}


def _statement(sql: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        for name in _STAR:
            table(spark, folder, name).createOrReplaceTempView(name)
        status, frame, error = results.plan_of(spark, sql)
        if frame is None:
            raise ValueError(f"{status}: {error}")
        return frame

    return run


for _name, _text in STATEMENTS.items():
    QUERIES[_name], SQL[_name] = _statement(_text), _text


def _streamed(spark: SparkSession, folder: str) -> DataFrame:
    from corvane.streaming import predictions

    return predictions.run_once(predictions.windowed_latency(predictions.prediction_stream(spark, f"{folder}/generation_result.parquet")))


@query("SELECT model_id, CAST(date_trunc('day', logged_at) AS TIMESTAMP) AS start, count(*) AS n, max(latency_ms) AS max_latency, count(*) FILTER (finish_reason = 'length') AS n_cut FROM generation_result GROUP BY 1, 2")
def stream_latency(spark: SparkSession, folder: str) -> DataFrame:
    return _streamed(spark, folder).drop("mean_latency")


@query("SELECT model_id, CAST(date_trunc('day', logged_at) AS TIMESTAMP) AS start, CAST(sum(CAST(latency_ms AS DECIMAL(18, 4))) AS DOUBLE) / count(latency_ms) AS mean_latency FROM generation_result GROUP BY 1, 2")
def stream_mean_latency(spark: SparkSession, folder: str) -> DataFrame:
    return _streamed(spark, folder).select("model_id", "start", "mean_latency")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
