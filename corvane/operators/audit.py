"""Contamination audit between a training pool and evaluation partitions.

Tables carry (id, question, db_id, gold_sql, split). Exact duplicates are equi-joins on a normalised key; near
ones an inverted index over n-grams with prefix filtering, so that no pair of rows is looked at unless it shares
one of its rarest grams.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import gram_hashes, normalize_question, normalize_sql, tokens
from corvane.staging import stage


def exact_duplicates(train: DataFrame, evaluation: DataFrame, key: Column, train_id: str = "id", eval_id: str = "id") -> DataFrame:
    """(train_id, eval_id, matched): pairs with the same non-empty key; a row never pairs with its own id."""
    a = train.select(F.col(train_id).alias("train_id"), key.alias("matched")).where("matched <> ''").distinct()
    b = evaluation.select(F.col(eval_id).alias("eval_id"), key.alias("matched")).where("matched <> ''").distinct()
    return a.join(b, "matched").where("train_id <> eval_id").select("train_id", "eval_id", "matched")


def exact_question_duplicates(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    return exact_duplicates(train, evaluation, normalize_question(F.col("question")))


def exact_sql_duplicates(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    return exact_duplicates(train, evaluation, normalize_sql(F.col("gold_sql")))


def gram_sets(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(id, norm, grams): the normalised text and its distinct n-grams as hashes; texts without grams are left out."""
    norm = normalize_question(F.col(text))
    out = df.select(F.col(key).alias("id"), norm.alias("norm")).where("norm <> '' and id is not null").distinct()
    return out.withColumn("grams", gram_hashes(tokens(F.col("norm")), n))


def ngram_overlap(documents: DataFrame, passages: DataFrame, n: int = 8, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, shared, jaccard, containment) of all pairs that share an n-gram.

    ``passages`` is the query side: its grams are joined to the documents' exploded ones, which are counted per pair
    before the shuffle. containment is shared grams by the passage's grams.
    """
    doc = gram_sets(documents, doc_id, text, n)
    item = gram_sets(passages, item_id, text, n)
    d = doc.select(F.col("id").alias("doc_id"), F.size("grams").alias("nd"), F.explode("grams").alias("g"))
    i = item.select(F.col("id").alias("item_id"), F.size("grams").alias("ni"), F.explode("grams").alias("g"))
    shared = d.join(i, "g").groupBy("doc_id", "item_id", "nd", "ni").agg(F.count(F.lit(1)).alias("shared"))
    union = F.col("nd") + F.col("ni") - F.col("shared")
    return shared.select("doc_id", "item_id", "shared", F.round(F.col("shared") / union, 4).alias("jaccard"), F.round(F.col("shared") / F.col("ni"), 4).alias("containment"))


def fuzzy_overlaps(train: DataFrame, evaluation: DataFrame, n: int = 4, threshold: str = "0.85") -> DataFrame:
    """(train_id, eval_id, score): question pairs with an n-gram Jaccard of at least ``threshold`` (exact
    duplicates included, score 1), the score rounded to 4 digits after the comparison.

    Equal normalised texts are compared once. A pair that reaches the threshold shares one of the
    |g| - ceil(t |g|) + 1 rarest grams of either side; it is verified at the first one. The threshold must be
    above 0: at 0 every pair would qualify.
    """
    t = Fraction(threshold)
    if not 0 < t <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    a, b = stage(gram_sets(train, "id", "question", n), "train"), stage(gram_sets(evaluation, "id", "question", n), "eval")
    texts = stage(a.select("norm", "grams").union(b.select("norm", "grams")).dropDuplicates(["norm"]), "texts")
    gram = F.explode("grams").alias("g")
    df = texts.select(gram).groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    least = F.floor((F.lit(t.numerator) * F.size("grams") + (t.denominator - 1)) / F.lit(t.denominator)).cast("int")
    ranked = texts.select("norm", gram).join(df, "g").groupBy("norm").agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "g"))), lambda s: s["g"]).alias("s"))
    keyed = texts.join(ranked, "norm").withColumn("pre", F.slice("s", 1, F.size("grams") - least + 1)).select("norm", "grams", "pre")
    keyed = stage(keyed, "prefixes")
    side = lambda ids, x: keyed.join(ids.select("norm").distinct(), "norm", "left_semi").select(F.col("norm").alias(f"{x}_norm"), F.col("grams").alias(f"{x}_g"), F.col("pre").alias(f"{x}_pre"), F.explode("pre").alias("k"))
    pairs = side(a, "a").join(side(b, "b"), "k")
    shared = F.size(F.array_intersect("a_g", "b_g"))
    sizes = (F.size("a_g") * t.denominator >= F.size("b_g") * t.numerator) & (F.size("b_g") * t.denominator >= F.size("a_g") * t.numerator)
    first = F.element_at(F.array_intersect("a_pre", "b_pre"), 1) == F.col("k")
    close = pairs.where(sizes & first).withColumn("shared", shared).withColumn("total", F.size("a_g") + F.size("b_g") - F.col("shared"))
    close = close.where(F.col("shared") * t.denominator >= F.col("total") * t.numerator)
    scored = close.select("a_norm", "b_norm", F.round(F.col("shared") / F.col("total"), 4).alias("score"))
    out = scored.join(a.select(F.col("norm").alias("a_norm"), F.col("id").alias("train_id")), "a_norm")
    out = out.join(b.select(F.col("norm").alias("b_norm"), F.col("id").alias("eval_id")), "b_norm")
    return out.where("train_id <> eval_id").select("train_id", "eval_id", "score")


def schema_overlaps(train: DataFrame, evaluation: DataFrame, db: str = "db_id") -> DataFrame:
    """(db_id, n_train, n_eval): databases on both sides with their numbers of rows."""
    a = train.groupBy(F.col(db).alias("db_id")).agg(F.count(F.lit(1)).alias("n_train"))
    b = evaluation.groupBy(F.col(db).alias("db_id")).agg(F.count(F.lit(1)).alias("n_eval"))
    return a.join(b, "db_id")


def split_leakage(train: DataFrame, split: str = "split") -> DataFrame:
    """Rows of a training pool whose split isn't train."""
    return train.where(F.coalesce(F.col(split) != "train", F.lit(True)))


def isolation_offenders(rows: DataFrame, forbidden_splits: tuple[str, ...] = ("dev", "test", "held_out"), forbidden_db_ids: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a forbidden split, whatever its case and outer blanks, or of a forbidden database."""
    return rows.where(F.lower(F.trim("split")).isin(*forbidden_splits) | (F.col("db_id").isin(*forbidden_db_ids) if forbidden_db_ids else F.lit(False)))


def assert_isolation(rows: DataFrame, order: str = "id", purpose: str = "training", **rules: tuple[str, ...]) -> None:
    """Raise on the first offender in order."""
    first = isolation_offenders(rows, **rules).orderBy(order).limit(1).collect()
    if first:
        raise ValueError(f"{purpose} rows must be isolated: {first[0][order]!r} is of split {first[0]['split']!r}, database {first[0]['db_id']!r}")


def audit_report(train: DataFrame, partitions: dict[str, DataFrame], n: int = 4, threshold: str = "0.85") -> DataFrame:
    """One row of counts: pairs compared, findings of each kind over all partitions, and whether the audit passed.

    It passes without leakage, shared databases and exact question duplicates; SQL and near duplicates are notices.
    """
    kinds = None

    def counted(kind: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")

    n_train = counted("n_train", train)
    for name in sorted(partitions):
        part = partitions[name]
        for kind, df in (("n_eval", part), ("exact_questions", exact_question_duplicates(train, part)), ("exact_sql", exact_sql_duplicates(train, part)), ("near_questions", fuzzy_overlaps(train, part, n, threshold)), ("shared_databases", schema_overlaps(train, part))):
            kinds = counted(kind, df) if kinds is None else kinds.unionAll(counted(kind, df))
    every = n_train.unionAll(counted("leakage", split_leakage(train)))
    every = every if kinds is None else every.unionAll(kinds)
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).cast("bigint")
    row = every.agg((total("n_train") * total("n_eval")).alias("pairs_compared"), *[total(k).alias(k) for k in ("leakage", "exact_questions", "exact_sql", "near_questions", "shared_databases")])
    return row.withColumn("passed", (F.col("leakage") == 0) & (F.col("shared_databases") == 0) & (F.col("exact_questions") == 0))
