"""SQL execution and result-set comparison: statuses, canonical cells, multiset and ordered equality, metrics."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import has_order_by, same_statement, trimmed

#: Error classes of the breakdown, in order.
ERROR_CLASSES = ("SYNTAX_ERROR", "QUERY_TIMEOUT", "EXECUTION_ERROR", "EXECUTION_MISMATCH")
#: Rows that ``run_sql`` fetches for display; comparisons never fetch.
ROW_CAP = 5000
#: Operators of the parsed plan that a query may consist of. Everything else is a command or a write.
QUERY_OPERATORS = frozenset(
    """Aggregate CTERelationDef CTERelationRef Distinct Except Expand Filter Generate GlobalLimit InlineTable Intersect Join
    LateralJoin LocalLimit LocalRelation Offset OneRowRelation$ OneRowRelation Pivot Project Range RecursiveCTE
    RepartitionByExpression Sample Sort SubqueryAlias Tail Union UnionLoop UnresolvedHaving UnresolvedHint
    UnresolvedInlineTable UnresolvedPivot UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction
    UnresolvedTVFAliases UnresolvedWith Unpivot UnpivotTransformer Window WithCTE WithWindowDefinition""".split()
)
#: Functions that run code outside of the engine.
FOREIGN_CALLS = re.compile(r"(?i)\b(?:java_method|reflect|try_reflect)\s*\(")


def canonical_cell(value: Column, kind: T.DataType, digits: int = 4) -> Column:
    """A cell as a typed string: floats rounded to ``digits`` (whole ones as integers), strings without outer
    blanks, NaN as a mark, null as null. Rounding makes buckets, no tolerance band."""
    if isinstance(kind, T.FloatType | T.DoubleType | T.DecimalType):
        x = F.round(value.cast("double"), digits)
        whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
        text = F.when(whole, x.cast("bigint").cast("string")).otherwise(x.cast("string"))
        return F.when(F.isnan(value.cast("double")), F.lit("f:nan")).otherwise(F.concat(F.lit("n:"), text))
    if isinstance(kind, T.IntegralType | T.BooleanType):
        return F.concat(F.lit("n:"), value.cast("bigint").cast("string"))
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit("b:"), F.hex(value))
    if isinstance(kind, T.StringType):
        return F.concat(F.lit("s:"), trimmed(value))
    return F.concat(F.lit("s:"), (F.to_json(value) if isinstance(kind, T.ArrayType | T.MapType | T.StructType) else value.cast("string")))


def canonical_rows(df: DataFrame, digits: int = 4) -> DataFrame:
    """(row array<string>): rows by position, whatever the columns are called."""
    renamed = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return renamed.select(F.array(*[canonical_cell(F.col(f.name), f.dataType, digits) for f in renamed.schema]).alias("row") if renamed.columns else F.array().cast("array<string>").alias("row"))


def row_differences(predicted: DataFrame, gold: DataFrame, digits: int = 4) -> DataFrame:
    """(row, surplus): canonical rows whose number differs; surplus counts predicted minus gold. One aggregate,
    partial before the shuffle."""
    both = canonical_rows(predicted, digits).withColumn("s", F.lit(1)).unionAll(canonical_rows(gold, digits).withColumn("s", F.lit(-1)))
    return both.groupBy("row").agg(F.sum("s").alias("surplus")).where("surplus <> 0")


def compare_results(predicted: DataFrame, gold: DataFrame, ordered: bool = False, digits: int = 4) -> DataFrame:
    """One row (n_predicted, n_gold, matches, tag): multiset equality, or equality by position if ``ordered``.

    Two empty results match with the tag AMBIGUOUS_EMPTY_SET; different numbers of rows or columns don't match;
    an ordered mismatch of equally many rows is tagged ORDER_BY_MISMATCH. ``ordered`` needs both frames to be
    sorted results: positions are taken from their partitions' order.
    """
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    sizes = count(predicted, "n_predicted").crossJoin(count(gold, "n_gold"))  # one row each
    if len(predicted.columns) != len(gold.columns):
        differing = sizes.select(F.lit(1).alias("n_diff"))
    elif ordered:
        a, b = _placed(canonical_rows(predicted, digits), "a"), _placed(canonical_rows(gold, digits), "b")
        differing = a.join(b, "place", "full").where(~F.col("a").eqNullSafe(F.col("b"))).agg(F.count(F.lit(1)).alias("n_diff"))
    else:
        differing = row_differences(predicted, gold, digits).agg(F.count(F.lit(1)).alias("n_diff"))
    empty = (F.col("n_predicted") == 0) & (F.col("n_gold") == 0)
    same = (F.col("n_predicted") == F.col("n_gold")) & (F.col("n_diff") == 0)
    tag = F.when(empty, "AMBIGUOUS_EMPTY_SET").when(~same & F.lit(ordered) & (F.col("n_predicted") == F.col("n_gold")), "ORDER_BY_MISMATCH")
    return sizes.crossJoin(differing).select("n_predicted", "n_gold", (empty | same).alias("matches"), tag.alias("tag"))  # one row each


def _placed(rows: DataFrame, name: str) -> DataFrame:
    """(place, name): rows numbered in the order of a sorted frame, by counts of its partitions."""
    marked = rows.select("row", F.monotonically_increasing_id().alias("_m"))
    split = marked.select("row", F.shiftright("_m", 33).alias("_p"), F.col("_m").bitwiseAND((1 << 33) - 1).alias("_i"))
    counts = split.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return split.join(counts.select("_p", before.alias("_b")), "_p").select((F.col("_b") + F.col("_i")).alias("place"), F.col("row").alias(name))


def _operators(plan: object) -> Iterator[str]:
    """The names of a JVM plan's operators; definitions of a WITH clause are queries by the grammar."""
    yield str(plan.getClass().getSimpleName())
    children = plan.children().iterator()
    while children.hasNext():
        yield from _operators(children.next())


def plan_of(spark: SparkSession, sql: str) -> tuple[str, DataFrame | None, str | None]:
    """(status, frame, error): parses and analyses one statement; only queries are admitted, by the operators of their plan.

    A blank or malformed text, several statements among them, is a SYNTAX_ERROR; unknown names are an EXECUTION_ERROR;
    commands and writes are an EXECUTION_ERROR and never run.
    """
    if not sql or not sql.strip():
        return "SYNTAX_ERROR", None, "empty statement"
    text = sql.strip().rstrip(";")
    try:
        logical = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException as e:
        return "SYNTAX_ERROR", None, str(e).split("\n")[0]
    except Exception as e:  # the gateway wraps some parser errors
        return ("SYNTAX_ERROR" if "PARSE" in str(e).upper() else "EXECUTION_ERROR"), None, str(e).split("\n")[0]
    if not QUERY_OPERATORS.issuperset(_operators(logical)) or FOREIGN_CALLS.search(text):
        return "EXECUTION_ERROR", None, "only queries are admitted"
    try:
        return "SUCCESS", spark.sql(text), None
    except AnalysisException as e:
        return "EXECUTION_ERROR", None, str(e).split("\n")[0]


def run_sql(spark: SparkSession, sql: str, timeout: float = 10.0, cap: int = ROW_CAP) -> tuple[str, list[tuple] | None, str | None]:
    """(status, rows, error) of one query: SUCCESS, SYNTAX_ERROR, EXECUTION_ERROR or TIMEOUT. At most ``cap`` rows
    are fetched. The jobs of a query that passes its time are cancelled."""
    status, frame, error = plan_of(spark, sql)
    if frame is None:
        return status, None, error
    return timed(spark, lambda: [tuple(r) for r in frame.limit(cap).collect()], timeout)


def timed(spark: SparkSession, action: Callable[[], object], timeout: float) -> tuple[str, object, str | None]:
    """(status, result, error) of an action whose jobs are cancelled when it passes its time."""
    tag, late = f"corvane-{uuid.uuid4().hex}", threading.Event()
    sc = spark.sparkContext

    def stop() -> None:
        late.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(timeout, stop)
    sc.addJobTag(tag)
    timer.start()
    try:
        return "SUCCESS", action(), None
    except Exception as e:
        return ("TIMEOUT", None, f"over {timeout} s") if late.is_set() else ("EXECUTION_ERROR", None, str(e).split("\n")[0])
    finally:
        timer.cancel()
        sc.removeJobTag(tag)


def score_pairs(spark: SparkSession, pairs: Iterable[tuple[str, str | None, str | None]], timeout: float = 10.0, threads: int = 4, exists: Callable[[str], bool] = lambda _: True) -> DataFrame:
    """(example_id, exact_match, execution_match, success, syntax_valid, anomaly, tag) for (id, predicted, gold) texts.

    Both results are compared whole where they are (``compare_results``); nothing but the verdict is fetched. One Spark
    job per pair, run from a bounded pool of threads: a benchmark's pairs, not a data set's rows. A pair whose gold query
    fails or runs out of time is unsupported and scores 0. Without a database (``exists``) the exact match stands in for
    execution. Errors at run time and timeouts count as valid syntax.
    """

    def strip(sql: str | None) -> str:
        return (sql or "").strip().rstrip(";")

    def failed(key: str, exact: float, status: str) -> tuple:
        return key, exact, 0.0, False, status != "SYNTAX_ERROR", {"TIMEOUT": "QUERY_TIMEOUT"}.get(status, status), None

    def one(pair: tuple[str, str | None, str | None]) -> tuple:
        key, predicted, gold = pair
        if predicted is None:
            return key, 0.0, 0.0, False, False, "MISSING_GENERATION", None
        exact = float(strip(predicted) == strip(gold))
        if not exists(key):
            return key, exact, exact, bool(exact), bool(exact), None, "UNSUPPORTED"
        unsupported = key, exact, 0.0, False, False, "GOLD_EXECUTION_FAILURE", "UNSUPPORTED"
        status, want, _ = plan_of(spark, gold or "")
        if want is None:
            return unsupported
        status, got, _ = plan_of(spark, predicted)
        if got is None:
            return failed(key, exact, status)
        ordered = bool(re.search(r"(?i)\border\s+by\b", gold or ""))
        status, row, _ = timed(spark, lambda: compare_results(got, want, ordered).first(), timeout)
        if status != "SUCCESS":  # whose fault it is, the gold query alone tells
            alone, _, _ = timed(spark, lambda: want.write.format("noop").mode("overwrite").save(), timeout)
            return failed(key, exact, status) if alone == "SUCCESS" else unsupported
        same = row["matches"]
        return key, exact, float(same), True, True, None if same else "EXECUTION_MISMATCH", row["tag"]

    with ThreadPoolExecutor(threads) as pool:
        rows = list(pool.map(one, pairs))
    return spark.createDataFrame(rows, "example_id string, exact_match double, execution_match double, success boolean, syntax_valid boolean, anomaly string, tag string")


def last_predictions(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of each key the last record by ``order``; a maximum per key, partial before the shuffle."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_m")).select(key, *[F.col(f"_m.{c}").alias(c) for c in rest])


def text_scores(gold: DataFrame, predictions: DataFrame, key: str = "example_id", gold_sql: str = "gold_sql", predicted: str = "generated_sql") -> DataFrame:
    """Every gold row with ``predicted``, exact_match (0 where no prediction came) and missing, by left join."""
    p = predictions.select(key, predicted)
    joined = gold.join(p, key, "left")
    return joined.withColumn("missing", F.col(predicted).isNull()).withColumn("exact_match", F.when(same_statement(F.col(predicted), F.col(gold_sql)), 1.0).otherwise(0.0)).withColumn("ordered", has_order_by(F.col(gold_sql)))


def rates(scores: DataFrame, flags: list[str], by: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Number of rows and the mean of each 0/1 column over all rows (of each group), rounded."""
    aggs = [F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.col(f).cast("double")), digits).alias(f"{f}_rate") for f in flags]]
    return scores.groupBy(*(by or [])).agg(*aggs)


def run_totals(log: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, prompt_tokens, completion_tokens, cost, n_stopped, n_cut, n_failed): plain sums over a log and its counts by
    reason of finishing; cost is a sum of decimals of twelve places, so it doesn't depend on the order of rows."""
    reason = lambda x: F.count_if(F.coalesce(F.col("finish_reason") == x, F.lit(False)))
    zero = F.lit(0).cast("bigint")
    cost = F.coalesce(F.sum(F.col("cost_usd").cast("decimal(24,12)")).cast("double"), F.lit(0.0))
    return log.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("prompt_tokens"), zero).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), zero).alias("completion_tokens"), cost.alias("cost"), reason("stop").alias("n_stopped"), reason("length").alias("n_cut"), (F.count(F.lit(1)) - reason("stop") - reason("length")).alias("n_failed"))


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows by ``order``; ``order`` must be unique for a defined result."""
    if n < 0:
        raise ValueError("n must not be negative")
    return df.orderBy(*order).limit(n)


def error_breakdown(scores: DataFrame, anomaly: str = "anomaly") -> DataFrame:
    """(error, n) for exactly the four error classes, zeros included."""
    counts = [F.struct(F.lit(c).alias("error"), F.count_if(F.col(anomaly) == c).alias("n")) for c in ERROR_CLASSES]
    return scores.agg(F.array(*counts).alias("x")).select(F.explode("x").alias("e")).select("e.*")


def nearest_rank(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, n, p50, p95): the upper median sorted[n // 2] and sorted[ceil(0.95 n) - 1] of the non-null values;
    groups without values get 0. Values are counted first; their running counts are summed over range partitions, so
    no task holds a group."""
    from corvane.operators.running import running_sums

    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    run = running_sums(counts, ["_v"], "_n", groups, "_run")
    totals = run.groupBy(*[F.col(g).alias(f"_t{i}") for i, g in enumerate(groups)]).agg(F.sum("_n").alias("_all"))
    of_group = F.lit(True)
    for i, g in enumerate(groups):
        of_group = of_group & F.col(g).eqNullSafe(F.col(f"_t{i}"))
    known = run.join(totals, of_group) if groups else run.crossJoin(totals)  # without groups totals is one row
    at = lambda rank: F.min(F.when(F.col("_run") >= rank, F.col("_v")))
    found = known.groupBy(*groups).agg(F.max("_all").alias("n"), at(F.floor(F.col("_all") / 2) + 1).alias("p50"), at(F.ceil(F.col("_all") * 0.95)).alias("p95"))
    if not groups:
        return found.select(F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), F.coalesce("p50", F.lit(0.0)).alias("p50"), F.coalesce("p95", F.lit(0.0)).alias("p95"))
    every = df.select(*groups).distinct()
    same = F.lit(True)
    right = found.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], "n", "p50", "p95")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return every.join(right, same, "left").select(*groups, F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), F.coalesce("p50", F.lit(0.0)).alias("p50"), F.coalesce("p95", F.lit(0.0)).alias("p95"))


def marker_scores(predictions: DataFrame, gold: DataFrame, key: str = "example_id") -> DataFrame:
    """Scores of marked test predictions, over predictions: outcome malformed, timeout or ok by the marker in the
    text, and exact_match of an ok one after its marker is removed."""
    sql = F.col("generated_sql")
    outcome = F.when(F.contains(sql, F.lit("MOCK_SYNTHETIC_MALFORMED")), "malformed").when(F.contains(sql, F.lit("MOCK_SYNTHETIC_TIMEOUT")) | F.coalesce(F.col("finish_reason") == "timeout", F.lit(False)), "timeout").otherwise("ok")
    joined = predictions.join(gold.select(key, F.col("gold_sql").alias("_gold"), F.col("difficulty").alias("_d")), key, "left")
    plain = F.replace(sql, F.lit("/* MOCK_SYNTHETIC */"), F.lit(""))
    hit = (F.col("outcome") == "ok") & same_statement(plain, F.col("_gold"))
    return joined.withColumn("outcome", outcome).withColumn("exact_match", hit.cast("double")).withColumn("difficulty", F.coalesce("_d", F.lit("unclassified"))).drop("_gold", "_d")


def marked_predictions(examples: DataFrame, key: str = "example_id") -> DataFrame:
    """Deterministic test predictions: malformed or timed out by the id's text, else the gold query behind a marker."""
    kind = F.when(F.lower(F.col(key)).contains("malformed"), "malformed").when(F.lower(F.col(key)).contains("timeout"), "timeout").otherwise("ok")
    text = F.when(F.col("_k") == "malformed", "/* MOCK_SYNTHETIC_MALFORMED */ SELECT FROM WHERE (syntax_error);").when(F.col("_k") == "timeout", "/* MOCK_SYNTHETIC_TIMEOUT */ SELECT * FROM heavy_table WHERE sleep(100);").otherwise(F.concat(F.lit("/* MOCK_SYNTHETIC */ "), F.coalesce(F.trim("gold_sql"), F.lit("SELECT 1;"))))
    return examples.withColumn("_k", kind).select(key, text.alias("generated_sql"), F.when(F.col("_k") == "timeout", "timeout").otherwise("stop").alias("finish_reason"))
