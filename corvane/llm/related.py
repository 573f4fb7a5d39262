"""Splits that keep related records together (problem 1): Boruvka contraction and a systematic deal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.words import level_name, strip
from corvane.operators.running import running_sums
from corvane.staging import drop, stage

#: Names that relate nothing.
NO_NAME = ("", "unknown", "n/a")
#: Groups of a size band that are dealt to the splits in one round.
ROUND = 24


def spanning_forest(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Label the connected components of a graph by Boruvka contraction.

    ``vertices`` (v string), ``edges`` (a string, b string); ends that aren't among the vertices are added,
    repeated edges and loops are harmless, nulls must be filtered before. Returns the spanning forest
    (a, b), one row per contracted edge, and the labels (v, root). Both are written tables.

    Each round every component picks its least outgoing edge under one total order (hash, then ends),
    so picks close no cycle but the mutual pick of two components, which the lesser one roots; pointer
    jumping then labels the picked trees, and the surviving edges are reduced to the least one between
    two components. Components at least halve each round. A vertex with a third of all edges costs a
    partial minimum per task, no more.
    """
    ends = edges.where("a <> b").distinct()
    labels = stage(vertices.select("v").union(ends.select("a")).union(ends.select("b")).distinct().select("v", F.col("v").alias("root")), "labels")
    left = stage(ends.select(F.struct(F.xxhash64("a", "b").alias("h"), "a", "b").alias("w"), F.col("a").alias("ca"), F.col("b").alias("cb")), "edges")
    forest = []
    while not left.isEmpty():
        both = left.select(F.col("ca").alias("c"), F.col("cb").alias("o"), "w").union(left.select(F.col("cb").alias("c"), F.col("ca").alias("o"), "w"))
        best = stage(both.groupBy("c").agg(F.min(F.struct("w", "o")).alias("m")).select("c", "m.o", "m.w"), "picks")
        forest.append(best.select("w.a", "w.b").distinct())
        other = best.select(F.col("c").alias("o"), F.col("o").alias("oo"))
        mutual = (F.col("oo") == F.col("c")) & (F.col("c") < F.col("o"))
        jump = stage(best.join(other, "o").select("c", F.when(mutual, F.col("c")).otherwise(F.col("o")).alias("p")), "parents")
        while True:
            up = jump.select(F.col("c").alias("p"), F.col("p").alias("p2"))
            upper = jump.select(F.col("c").alias("p2"), F.col("p").alias("p3"))
            nxt = stage(jump.join(up, "p").join(upper, "p2").select("c", F.col("p3").alias("p"), (F.col("p2") != F.col("p3")).alias("moved")), "parents")
            drop(jump)
            jump = nxt
            if nxt.where("moved").isEmpty():
                break
        old = labels, left, jump
        labels = stage(
            labels.join(jump.select(F.col("c").alias("root"), "p"), "root", "left").select("v", F.coalesce("p", "root").alias("root")), "labels"
        )
        to_a = jump.select(F.col("c").alias("ca"), F.col("p").alias("ra"))
        to_b = jump.select(F.col("c").alias("cb"), F.col("p").alias("rb"))
        left = stage(
            left.join(to_a, "ca").join(to_b, "cb").where("ra <> rb")
            .groupBy(F.least("ra", "rb").alias("ca"), F.greatest("ra", "rb").alias("cb"))
            .agg(F.min("w").alias("w"))
            .select("w", "ca", "cb"),
            "edges",
        )
        drop(*old)
    spark = labels.sparkSession
    trees = spark.createDataFrame([], "a string, b string")
    for f in forest:
        trees = trees.union(f)
    return trees, labels


def shared_name(name: Column) -> Column:
    """The name two records must share to be related, null where it relates nothing."""
    plain = F.lower(strip(name))
    return F.when(~plain.isin(*NO_NAME), plain)


def related_databases(catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(forest, groups): groups has (db_key, root), one row per levelled db_id of the catalogue.

    Databases are tied to the names of their author and origin, so a name shared by many databases is a
    star and not all their pairs. Null db_ids are left out; a row without names is a group of its own.
    """
    keyed = catalog.select(level_name(F.col("db_id")).alias("k"), shared_name(F.col("author")).alias("author"), shared_name(F.col("origin")).alias("origin")).where("k is not null")
    tie = lambda c: keyed.where(F.col(c).isNotNull()).select(F.concat(F.lit("d:"), "k").alias("a"), F.concat(F.lit(c[0] + ":"), c).alias("b"))
    forest, labels = spanning_forest(keyed.select(F.concat(F.lit("d:"), "k").alias("v")), tie("author").union(tie("origin")))
    groups = labels.where(F.col("v").startswith("d:")).select(F.expr("substring(v, 3)").alias("db_key"), "root")
    return forest, groups


def torn_databases(catalog: DataFrame, records: DataFrame) -> DataFrame:
    """(db_id): databases with rows in a split, of groups whose rows carry two or more splits."""
    _, groups = related_databases(catalog)
    split = F.lower(strip(F.col("split")))
    seen = records.select(level_name(F.col("db_id")).alias("db_key"), split.alias("split")).where("db_key is not null and split is not null").distinct()
    seen = stage(seen.join(groups, "db_key"), "seen")
    torn = seen.groupBy("root").agg(F.count_distinct("split").alias("k")).where("k > 1").select("root")
    keys = seen.join(torn, "root", "left_semi").select("db_key").distinct()
    return catalog.select("db_id", level_name(F.col("db_id")).alias("db_key")).join(keys, "db_key", "left_semi").select("db_id").distinct()


def deal_groups(sizes: DataFrame, targets: dict[str, float], seed: str = "deal") -> DataFrame:
    """Assign groups (root, n) to splits in the proportions of ``targets``: (root, n, split).

    Groups are stratified by size band (powers of two), larger bands first. Within a band they are dealt
    systematically: along the running size of their seeded hash order the band is walked in rounds of about
    ``ROUND`` groups, and each round is cut by the shares the splits still lack. What the large groups overshoot,
    the small ones make up for. The driver sees one total per band and split, at most 64 bands; each band is read
    from its own partition. A group larger than its split's share keeps together all the same.
    """
    names = sorted(targets)
    banded = sizes.withColumn("band", F.floor(F.log2("n")).cast("int")).withColumn("_h", F.xxhash64(F.lit(seed), "root"))
    ranked = stage(running_sums(banded, ["_h", "root"], "n", ["band"]), "bands", ["band"])
    bands = {r["band"]: (r["n"], r["groups"]) for r in ranked.groupBy("band").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups")).collect()}
    total = sum(n for n, _ in bands.values())
    lack = {s: total * targets[s] / sum(targets.values()) for s in names}
    dealt = None
    for band in sorted(bands, reverse=True):
        size, groups = bands[band]
        need = {s: max(0.0, lack[s]) for s in names}
        if not sum(need.values()):
            need = {s: targets[s] for s in names}
        around = size / max(1, groups // ROUND)
        place = F.pmod(F.col("running") - F.col("n") / 2, F.lit(around)) / around
        split = F.lit(max(need, key=lambda s: (need[s], s)))
        for s in reversed(names):
            if need[s] > 0:
                split = F.when(place <= sum(need[x] for x in names[: names.index(s) + 1]) / sum(need.values()), F.lit(s)).otherwise(split)
        one = ranked.where(F.col("band") == band).select("root", "n", split.alias("split"))
        for r in one.groupBy("split").agg(F.sum("n").alias("n")).collect():
            lack[r["split"]] -= r["n"]
        dealt = one if dealt is None else dealt.union(one)
    return dealt if dealt is not None else sizes.select("root", "n", F.lit(None).cast("string").alias("split"))


def split_records(catalog: DataFrame, tables: dict[str, tuple[DataFrame, str]], targets: dict[str, float]) -> DataFrame:
    """(origin, record_id, root, split) for the records of ``tables`` (name -> (table, id column)).

    A record belongs to its database's related group; a db_id outside the catalogue is a group of its own,
    a record without db_id likewise. Rows repeated under one id count once. Group sizes are counted before
    the deal, with partial aggregation; the catalogue side is joined as Spark's size statistics allow.
    """
    _, groups = related_databases(catalog)
    records = None
    for name, (df, key) in tables.items():
        one = df.select(F.lit(name).alias("origin"), F.col(key).alias("record_id"), level_name(F.col("db_id")).alias("db_key")).distinct()
        records = one if records is None else records.union(one)
    lone = F.concat_ws(":", F.lit("lone"), "origin", F.coalesce("db_key", "record_id", F.lit("")))
    placed = stage(records.join(groups, "db_key", "left").select("origin", "record_id", F.coalesce("root", lone).alias("root")), "placed")
    dealt = deal_groups(placed.groupBy("root").agg(F.count(F.lit(1)).alias("n")), targets)
    return placed.join(dealt.select("root", "split"), "root").select("origin", "record_id", "root", "split")
