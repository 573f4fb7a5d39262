from pyspark.sql import functions as F

from corvane.functions import text as X


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


def test_normalize_question(spark):
    assert one(spark, X.normalize_question, "  How many  Singers, do we have?! ") == "how many singers do we have"
    assert one(spark, X.normalize_question, "") == ""
    assert one(spark, X.normalize_question, None) is None


def test_normalize_sql(spark):
    assert one(spark, X.normalize_sql, "SELECT /* a */ X -- b\n FROM t ;; ; ") == "select x from t"
    assert one(spark, X.normalize_sql, "select ';'") == "select ';'"


def test_ngrams(spark):
    grams = lambda n: lambda c: X.ngrams(X.tokens(c), n)
    assert one(spark, grams(4), "a b c d e") == ["a b c d", "b c d e"]
    assert one(spark, grams(4), "a b") == ["a b"]
    assert one(spark, grams(4), "") == []
    assert one(spark, grams(2), "a a a") == ["a a"]


def test_grams_of_a_long_text_are_linear(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    assert len(one(spark, lambda c: X.ngrams(X.tokens(c), 8), long)) == 20_000 - 7


def test_jaccard(spark):
    rows = spark.createDataFrame([("a b c d", "a b c d"), ("a b c d e", "a b c d f"), ("", "a"), ("", "")], "a string, b string")
    assert [r[0] for r in rows.select(X.jaccard(F.col("a"), F.col("b"), 4)).collect()] == [1.0, 1 / 3, 0.0, 0.0]


def test_search_terms_and_estimate(spark):
    assert one(spark, X.search_terms, "Ab_1 éa1 x-y") == ["ab_1", "x", "y"]
    assert one(spark, X.token_estimate, "abcdefgh") == 3
    assert one(spark, X.token_estimate, "a b c d e") == 5
    assert one(spark, X.token_estimate, None) == 0


def test_identifiers(spark):
    got = [one(spark, X.quote_identifier, v) for v in ("name", " order ", 'a"b', "", "1x")]
    assert got == ["name", '"order"', '"a""b"', '""', '"1x"']


def test_clean_model_sql(spark):
    got = [one(spark, X.clean_model_sql, v) for v in ("select 1", "text\n```sql\nselect 2\n```", "```\nWITH a AS (select 1) select * from a;\n```", "```json\n{}\n```")]
    assert got == ["select 1;", "select 2;", "WITH a AS (select 1) select * from a;", "```json\n{}\n```;"]


def test_small_rules(spark):
    assert one(spark, X.has_order_by, "select 1 ORDER  by 1") is True
    assert one(spark, X.has_order_by, None) is False
    assert one(spark, X.first_keyword, "  drop table t") == "DROP"
    assert one(spark, X.first_keyword, " ") == ""
    assert one(spark, X.masked, "abcd1234efgh") == "abcd...efgh"
    assert one(spark, X.masked, "short") == "********"
