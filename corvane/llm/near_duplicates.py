"""Near-duplicate records with small edits (problem 2): tensored banding, then exact verification.

Every text of a record gives one small collection of hash values. Table keys combine pairs of values, of two texts'
collections or of one text's own, so a record with k values a collection computes about 2 k hashes for k * k keys; two
records meet in a table only if they share both halves of its key.

* A text of up to ``LONG`` words gives a bottom-k sketch under one permutation of the words that puts rare words first.
  With a bound t on the similarity, n - ceil(t * n) + v values of a text with n words are certain to hold the first v
  words it shares with any similar text (v = 1 in a pair of collections, 2 in one collection): no pair is lost.
* A text of over ``LONG`` words gives ``HALVES`` MinHash values, each of ``ROWS`` minima, and in a pair of one text's own
  two such collections. At a similarity of exactly 0.7 a pair is found with a probability of over 0.999. Texts of up to
  LONG / t words give both kinds, since they may be similar to texts on either side of the bound.

Keys shared by more than ``HOT`` records are split by the pairs of text lengths that may meet there, under which the
sketches are as short as these allow, and then by up to ``MORE`` further shared words, where similar texts of these
lengths must share more words than the key names; that loses no pair either. Each candidate pair is verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.words import word_hashes
from corvane.llm.related import spanning_forest
from corvane.staging import stage

#: Words above which a text is long; MinHash values of a collection and minima a value for long texts.
LONG, HALVES, ROWS = 40, 12, 2
#: Records that share a key before it is split, and further words that split it. Every word more may multiply a record's
#: rows by the places it can stand at, so their number is small.
HOT, MORE = 64, 2
#: A word in at least one of so many texts counts as frequent; so at most FREQUENT times the mean number of
#: words of a record are frequent, and that bounds what is broadcast.
FREQUENT = 2000

#: Per text: its number of words, the place of the last word the key names, and how many shared words it names.
PLACES = "n0 int, j0 int, d0 int, n1 int, j1 int, d1 int"
Table = tuple[DataFrame, str, list[str]]


def similar(a: Column, b: Column, t: Fraction) -> Column:
    """Whether two sets (arrays without repeats) reach the similarity t; false if one is empty."""
    shared = F.size(F.array_intersect(a, b))
    return (shared > 0) & (shared * t.denominator >= (F.size(a) + F.size(b) - shared) * t.numerator)


def seeded_min(values: Column, seed: int) -> Column:
    """The least seeded hash of an array's values: one MinHash."""
    return F.array_min(F.transform(values, lambda w: F.xxhash64(w, F.lit(seed))))


def _overlap_least(t: Fraction, n: Column, m: Column) -> Column:
    """Words that texts of n and m words share at least if their similarity reaches t."""
    return F.floor((F.lit(t.numerator) * (n + m) + (t.numerator + t.denominator - 1)) / F.lit(t.numerator + t.denominator)).cast("int")


def _mixed(*parts: np.ndarray | int) -> np.ndarray:
    """One 64-bit hash of several integers, an array's value by value."""
    out = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            x = (np.asarray(p).astype(np.int64).view(np.uint64) if isinstance(p, np.ndarray) else np.uint64(p)) ^ out
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out = (x ^ (x >> np.uint64(31))) + np.uint64(0x9E3779B97F4A7C15)
    return out.view(np.int64) if isinstance(out, np.ndarray) else np.int64(out.view(np.int64))


class Sketches:
    """The words of a batch's texts (a list column of word hashes), rare words first."""

    def __init__(self, column: pa.Array, words: np.ndarray, counts: np.ndarray) -> None:
        offsets = column.offsets.to_numpy().astype(np.int64)
        flat = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        self.n = np.diff(offsets)
        row = np.repeat(np.arange(len(self.n)), self.n)
        at = np.minimum(np.searchsorted(words, flat), max(0, len(words) - 1))
        rarity = np.where(words[at] == flat, counts[at], 0) if len(words) else np.zeros(len(flat), np.int64)
        self.flat, self.begin = flat[np.lexsort((flat, rarity, row))], np.cumsum(self.n) - self.n

    def first(self, rows: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into ``rows``, value, place from 1) of the first k values of each row."""
        which = np.repeat(np.arange(len(rows)), k)
        place = np.arange(len(which)) - np.repeat(np.cumsum(k) - k, k)
        return which, self.flat[self.begin[rows][which] + place], place + 1

    def minima(self, rows: np.ndarray, collection: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``first``, for HALVES MinHash values of each row; they name no place (0)."""
        which, value, _ = self.first(rows, self.n[rows])
        edge = np.cumsum(self.n[rows]) - self.n[rows]
        least = lambda seed: np.minimum.reduceat(_mixed(value, seed), edge) if len(rows) else np.zeros(0, np.int64)
        halves = [_mixed(*[least(1 + collection * 10_000 + h * 100 + r) for r in range(ROWS)], h) for h in range(HALVES)]
        return np.repeat(np.arange(len(rows)), HALVES), np.stack(halves, axis=1).reshape(-1), np.zeros(len(rows) * HALVES, np.int64)


def _product(a: np.ndarray, b: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of an entry of ``a`` and one of ``b`` (sorted row numbers) in the same row."""
    size, start = np.bincount(b, minlength=rows), np.searchsorted(b, np.arange(rows))
    left = np.repeat(np.arange(len(a)), size[a])
    return left, np.arange(len(left)) - np.repeat(np.cumsum(size[a]) - size[a], size[a]) + start[a][left]


def _share_of(t: tuple[int, int], n: np.ndarray) -> np.ndarray:
    """The least whole number of words that is a share t of n words."""
    return -(-n * t[0] // t[1])


def _keys(frequent: Broadcast, t: tuple[int, int]) -> object:
    """Table keys of the classes (c, origin, w0, w1): (key, c, PLACES)."""

    def collections(s: Sketches, rows: np.ndarray, number: int) -> Iterator[tuple[int, np.ndarray, tuple]]:
        """(kind, rows, values) of the sketches of the short rows and the MinHash values of the long ones."""
        n = s.n[rows]
        short, long = rows[n <= LONG * t[1] // t[0]], rows[n > LONG]
        if len(short):
            yield 1, short, s.first(short, s.n[short] - _share_of(t, s.n[short]) + 1)
        if len(long):
            yield 0, long, s.minima(long, number)

    def two_texts(s0: Sketches, s1: Sketches, rows: np.ndarray) -> Iterator[tuple]:
        for kind0, rows0, _ in collections(s0, rows, 0):
            for kind1, both, (which1, value1, place1) in collections(s1, rows0, 1):
                which0, value0, place0 = s0.first(both, s0.n[both] - _share_of(t, s0.n[both]) + 1) if kind0 else s0.minima(both, 0)
                i, j = _product(which0, which1, len(both))
                row = both[which0[i]]
                yield row, _mixed(value0[i], value1[j], kind0 * 2 + kind1), place0[i], np.full(len(i), kind0), place1[j], np.full(len(i), kind1)

    def one_text(s: Sketches, rows: np.ndarray) -> Iterator[tuple]:
        n = s.n[rows]
        none = lambda x: (np.zeros(len(x), np.int64), np.zeros(len(x), np.int64))
        short = rows[(n > 1) & (n <= LONG * t[1] // t[0])]
        k = np.minimum(s.n[short], s.n[short] - _share_of(t, s.n[short]) + 2)
        which, value, place = s.first(short, k)
        i, j = _product(which, which, len(short))
        i, j = i[place[i] < place[j]], j[place[i] < place[j]]
        yield short[which[i]], _mixed(value[i], value[j], 4), place[j], np.full(len(i), 2), *none(i)
        lone = rows[_share_of(t, n) == 1]  # texts so short that one shared word may do
        which, value, place = s.first(lone, s.n[lone])
        yield lone[which], _mixed(value, 5), place, np.ones(len(which), np.int64), *none(which)
        long = rows[n > LONG]
        if len(long):
            (a, x, _), (b, y, _) = s.minima(long, 0), s.minima(long, 1)
            i, j = _product(a, b, len(long))
            yield long[a[i]], _mixed(x[i], y[j], 6), *none(i), *none(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                s0, s1 = (Sketches(batch.column(c), *frequent.value) for c in ("w0", "w1"))
                c, origin = batch.column("c").to_numpy(), batch.column("origin").to_numpy()
                alone = s1.n == 0
                for row, key, j0, d0, j1, d1 in [*one_text(s0, np.flatnonzero(alone)), *two_texts(s0, s1, np.flatnonzero(~alone))]:
                    yield _rows(_mixed(key, origin[row].astype(np.int64)), c[row], s0.n[row], j0, d0, s1.n[row], j1, d1)

    return run


def _rows(key: np.ndarray, c: np.ndarray, *places: np.ndarray) -> pa.RecordBatch:
    names = ("n0", "j0", "d0", "n1", "j1", "d1", "m0", "m1")
    return pa.RecordBatch.from_pydict({"key": key, "c": c} | {k: v.astype(np.int32) for k, v in zip(names, places, strict=False)})


def _longer(frequent: Broadcast, t: tuple[int, int]) -> object:
    """Rows of hot keys with their class's words: each becomes one row for every next word it may share with texts of
    m0 and m1 words. The key's text is the first of which similar texts must share more words than the key names."""
    p, q = t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                key, c = batch.column("key").to_numpy(), batch.column("c").to_numpy()
                get = lambda k: batch.column(k).to_numpy().astype(np.int64)  # noqa: B023, E731
                n, m, j, d = ([get(f"{x}{i}") for i in (0, 1)] for x in "nmjd")
                least = [-(-(p * (n[i] + m[i])) // (p + q)) for i in (0, 1)]
                first = (j[0] > 0) & (least[0] > d[0])
                for i, chosen in ((0, first), (1, ~first)):
                    rows = np.flatnonzero(chosen)
                    s = Sketches(batch.column(f"w{i}"), *frequent.value)
                    last = np.minimum(n[i], n[i] - least[i] + d[i] + 1)[rows]
                    many = np.maximum(0, last - j[i][rows])
                    which = np.repeat(rows, many)
                    place = j[i][which] + 1 + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
                    value = s.flat[s.begin[which] + place - 1]
                    own = (n[i][which], place, d[i][which] + 1)
                    other = (n[1 - i][which], j[1 - i][which], d[1 - i][which])
                    both = (*own, *other) if i == 0 else (*other, *own)
                    yield _rows(_mixed(key[which], value, i), c[which], *both, m[0][which], m[1][which])

    return run


def _counted(keys: DataFrame) -> DataFrame:
    """Rows of the keys that several classes have, with their number: written, after one shuffle."""
    return stage(keys.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("k > 1"), "met")


def _split(keys: DataFrame, classes: DataFrame, frequent: Broadcast, t: Fraction) -> DataFrame:
    """(key, c, PLACES, m0, m1) of counted keys, the hot ones split; m is the other's length, null in an unsplit key."""
    columns = ["key", "c", "n0", "j0", "d0", "n1", "j1", "d1", "m0", "m1"]
    whole = lambda x: F.lit(None).cast("int").alias(x)
    done, hot = keys.where(F.col("k") <= HOT).select(*columns[:8], whole("m0"), whole("m1")), keys.where(F.col("k") > HOT)
    if hot.isEmpty():
        return done
    low = lambda n: F.ceil(F.lit(t.numerator) * n / F.lit(t.denominator)).cast("int")
    high = lambda n: F.floor(F.lit(t.denominator) * n / F.lit(t.numerator)).cast("int")
    reach = lambda i: F.col(f"d{i}") + F.col(f"n{i}") - F.col(f"j{i}") >= _overlap_least(t, F.col(f"n{i}"), F.col(f"m{i}"))
    met = hot.select(*columns[:8])
    for i in (0, 1):
        met = met.withColumn(f"m{i}", F.explode(F.sequence(low(F.col(f"n{i}")), high(F.col(f"n{i}"))))).where(reach(i))
    pair = [f(f"n{i}", f"m{i}") for i in (0, 1) for f in (F.least, F.greatest)]
    # which of the two records has the longer first text and which the longer second one
    turned = [F.when((F.col("n0") != F.col("m0")) & (F.col("n1") != F.col("m1")), (F.col("n0") < F.col("m0")) == (F.col("n1") < F.col("m1")))]
    met = _counted(met.withColumn("key", F.xxhash64("key", *pair, *turned)))
    words = classes.select("c", "w0", "w1")
    for _ in range(MORE):
        more = [(F.col(f"j{i}") > 0) & (_overlap_least(t, F.col(f"n{i}"), F.col(f"m{i}")) > F.col(f"d{i}")) for i in (0, 1)]
        open_ = (F.col("k") > HOT) & (more[0] | more[1])
        done = done.unionByName(met.where(~open_).select(*columns))
        left = met.where(open_)
        if left.isEmpty():
            return done
        longer = left.select(*columns).join(words, "c").mapInArrow(_longer(frequent, (t.numerator, t.denominator)), f"key bigint, c bigint, {PLACES}, m0 int, m1 int")
        met = _counted(longer)
    return done.unionByName(met.select(*columns))


def _candidates(keys: DataFrame, t: Fraction) -> DataFrame:
    """(a, b), a < b: distinct pairs of classes that meet in a table and can still reach ``t``.

    Two texts whose d-th shared word stands at places j and j' share at most d + min(n - j, n' - j') words; pairs that
    this rules out at their first key can't be similar, so any key may drop them.
    """
    side = lambda x: keys.select("key", *[F.col(c).alias(f"{x}_{c}") for c in keys.columns if c != "key"])
    met = side("a").join(side("b"), "key").where("a_c < b_c")
    for i in (0, 1):
        n, m = F.col(f"a_n{i}"), F.col(f"b_n{i}")
        met = met.where(F.col(f"a_m{i}").isNull() | ((F.col(f"a_m{i}") == m) & (F.col(f"b_m{i}") == n)))
        reach = F.least(*[F.col(f"{x}_d{i}") + F.col(f"{x}_n{i}") - F.col(f"{x}_j{i}") for x in "ab"])
        met = met.where((n * t.denominator >= m * t.numerator) & (m * t.denominator >= n * t.numerator) & (reach >= _overlap_least(t, n, m)))
    return met.select(F.col("a_c").alias("a"), F.col("b_c").alias("b")).distinct()


def _frequent_words(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The frequent words, sorted, and the number of classes each is in; all classes are counted."""
    floor = max(2, classes.count() // FREQUENT)
    counted = classes.select(F.explode(F.concat("w0", "w1")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= floor)
    found = counted.orderBy("w").toPandas()
    return found["w"].to_numpy(np.int64), found["df"].to_numpy(np.int64)


def class_pairs(classes: DataFrame, t: Fraction) -> DataFrame:
    """(a, b) with a < b: pairs of classes all of whose texts reach ``t``. ``classes``: written table (c, origin, w0, w1)."""
    frequent = classes.sparkSession.sparkContext.broadcast(_frequent_words(classes))
    keys = classes.select("c", "origin", "w0", "w1").mapInArrow(_keys(frequent, (t.numerator, t.denominator)), f"key bigint, c bigint, {PLACES}")
    met = _candidates(_split(_counted(keys), classes, frequent, t), t)
    side = lambda x: classes.select(F.col("c").alias(x), *[F.col(w).alias(f"{x}_{w}") for w in ("w0", "w1")])
    joined = met.join(side("a"), "a").join(side("b"), "b")
    return joined.where(similar(F.col("a_w0"), F.col("b_w0"), t) & ((F.size("a_w1") == 0) | similar(F.col("a_w1"), F.col("b_w1"), t))).select("a", "b")


def _classes(tables: list[Table]) -> tuple[DataFrame, DataFrame]:
    """(members, classes): members (origin, id, c) and classes (c, origin, w0, w1) of the records of several tables.

    Records of a table with equal word sets share a class; those with a wordless text have none. ``origin`` is the
    table's number. The words of the second text are told from the first one's by their hash.
    """
    base = None
    for origin, (records, key, texts) in enumerate(tables):
        if not 1 <= len(texts) <= 2:
            raise ValueError("records have one or two texts")
        hashes = [word_hashes(F.col(c)) for c in texts]
        hashes[1:] = [F.transform(h, lambda w: F.xxhash64(w, F.lit(1))) for h in hashes[1:]]
        sets = [F.array_sort(F.array_distinct(h)) for h in hashes]
        sets += [F.array().cast("array<bigint>")] * (2 - len(texts))
        one = records.where(F.col(key).isNotNull()).select(F.lit(origin).alias("origin"), F.col(key).alias("id"), *[s.alias(f"w{i}") for i, s in enumerate(sets)])
        for i in range(len(texts)):
            one = one.where(F.size(f"w{i}") > 0)
        base = one if base is None else base.unionByName(one)
    # two hashes with different seeds name a class
    base = stage(base.select("*", F.xxhash64(F.lit(1), "origin", "w0", "w1").alias("h"), F.xxhash64(F.lit(2), "origin", "w0", "w1").alias("g")), "records")
    classes = stage(base.dropDuplicates(["h", "g"]).select(F.monotonically_increasing_id().alias("c"), "h", "g", "origin", "w0", "w1"), "classes")
    members = base.select("id", "h", "g").distinct().join(classes.select("h", "g", "c", "origin"), ["h", "g"])
    return stage(members.select("origin", "id", "c"), "members"), classes.select("c", "origin", "w0", "w1")


def linked_pairs(tables: list[Table], threshold: str = "0.7") -> DataFrame:
    """(origin, id_a, id_b), id_a < id_b: records of one table all of whose texts have a word similarity of at least
    ``threshold``. ``tables``: (records, key column, one or two text columns); origin is the place in that list.

    Rows repeated under one id count once; null or wordless texts are similar to nothing; a null id is left
    out. Records with equal word sets are compared once, as one class, and only the result lists their pairs.
    """
    members, classes = _classes(tables)
    pairs = class_pairs(classes, Fraction(threshold))
    left = members.select("origin", F.col("c").alias("a"), F.col("id").alias("x"))
    right = members.select(F.col("c").alias("b"), F.col("id").alias("y"))
    across = pairs.join(left, "a").join(right, "b").where("x <> y")
    within = left.join(right, F.col("a") == F.col("b")).where("x < y")
    both = across.select("origin", "x", "y").union(within.select("origin", "x", "y"))
    return both.select("origin", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def similar_pairs(records: DataFrame, key: str, texts: list[str], threshold: str = "0.7") -> DataFrame:
    """(id_a, id_b): ``linked_pairs`` of one table."""
    return linked_pairs([(records, key, texts)], threshold).select("id_a", "id_b")


def linked_groups(tables: list[Table], threshold: str = "0.7") -> DataFrame:
    """(origin, id, group_id, n_links): every record with its group of linked records and its number of links.

    Copies aren't expanded into pairs: a record's links are its class's other members and those of every
    linked class. A record without words stands alone with no link.
    """
    members, classes = _classes(tables)
    pairs = stage(class_pairs(classes, Fraction(threshold)), "links")
    sizes = members.groupBy("c").agg(F.count(F.lit(1)).alias("size"))
    name = lambda x: F.col(x).cast("string")
    _, labels = spanning_forest(sizes.select(name("c").alias("v")), pairs.select(name("a").alias("a"), name("b").alias("b")))
    both = pairs.union(pairs.select("b", "a"))
    reach = both.join(sizes.select(F.col("c").alias("b"), "size"), "b").groupBy(F.col("a").alias("c")).agg(F.sum("size").alias("far"))
    of_class = sizes.join(reach, "c", "left").join(labels.select(F.col("v").cast("bigint").alias("c"), F.concat(F.lit("g"), "root").alias("group_id")), "c")
    of_class = of_class.select("c", "group_id", (F.col("size") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    grouped = members.join(of_class, "c").select("origin", "id", "group_id", "n_links")
    every = None
    for origin, (records, key, _) in enumerate(tables):
        one = records.select(F.lit(origin).alias("origin"), F.col(key).alias("id")).where("id is not null").distinct()
        every = one if every is None else every.unionByName(one)
    alone = every.join(members.select("origin", "id"), ["origin", "id"], "left_anti")
    return grouped.unionByName(alone.select("origin", "id", F.concat(F.lit("alone:"), "id").alias("group_id"), F.lit(0).cast("bigint").alias("n_links")))


def similar_groups(records: DataFrame, key: str, texts: list[str], threshold: str = "0.7") -> DataFrame:
    """(id, group_id, n_links): ``linked_groups`` of one table."""
    return linked_groups([(records, key, texts)], threshold).select("id", "group_id", "n_links")
