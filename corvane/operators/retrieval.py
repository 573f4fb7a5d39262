"""BM25 ranking of examples for a stated set of queries, batch-wise: postings, idf, scores and the k best.

Over a whole corpus nearly every row shares some common term with every query, so pairs are never rows of a table
there: the corpus and the queries are written once, a task reads some blocks of the one and a part of the other, and
returns the k best rows of each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructType

from corvane.functions.text import search_terms
from corvane.staging import open_shared, stage

K1, B = 1.5, 0.75
#: Terms of the corpus that a block holds, and queries that a part holds, about.
BLOCK_TERMS, BLOCK_QUERIES = 3_000_000, 200_000
#: If there are fewer blocks of the corpus, the queries are parted for so many pairs of blocks, but not into parts smaller than this.
PAIRS, LEAST_QUERIES = 12, 500
#: Blocks that one task goes through with its queries, if there are so many pairs that all tasks still have work.
BLOCKS = 16
#: Scores this close may be equal once they are rounded to 6 digits.
MARGIN = 2e-6


def postings(corpus: DataFrame, key: str, text: str) -> DataFrame:
    """(id, term, tf, length): term frequencies with the length of the row's text in terms."""
    terms = corpus.select(F.col(key).alias("id"), search_terms(F.col(text)).alias("t")).withColumn("length", F.size("t"))
    return terms.select("id", "length", F.explode("t").alias("term")).groupBy("id", "term", "length").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(corpus: DataFrame, text: str) -> DataFrame:
    """One row (n_docs, avg_length)."""
    return corpus.select(F.size(search_terms(F.col(text))).alias("n")).agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_length"))


def inverse_frequency(n: Column, df: Column) -> Column:
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5) + 1), F.lit(0.0))


def idf(posted: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf); idf is never negative."""
    df = posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(stats)).select("term", "df", inverse_frequency(F.col("n_docs"), F.col("df")).alias("idf"))  # stats is one row


def _read_block(files: list[tuple[str, int, int]], vocabulary: pa.Array, nulls: bool) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's rows their ids and lengths, and of each occurrence of a term of the vocabulary the row and the term.

    A file comes with a number of shares and the share that is meant; an id's rows are in one share of one file.
    """
    ids, lengths, rows, codes, n = [], [], [], [], 0
    for path, shares, share in files:
        with open_shared(path) as file:
            for batch in pq.ParquetFile(file).iter_batches(columns=["id", "length", "deal", "t"]):
                keep = np.ones(len(batch), bool) if nulls else pc.is_valid(batch["id"]).to_numpy(zero_copy_only=False)
                if shares > 1:
                    keep &= batch["deal"].to_numpy() % shares == share
                batch = batch.filter(pa.array(keep))
                code = pc.fill_null(pc.index_in(batch["t"].flatten(), value_set=vocabulary), -1).to_numpy()
                known = np.flatnonzero(code >= 0)
                ids.append(batch["id"])
                lengths.append(pc.fill_null(batch["length"], 0).to_numpy())
                rows.append(pc.list_parent_indices(batch["t"]).to_numpy()[known] + n)
                codes.append(code[known].astype(np.int64))
                n += len(batch)
    return pa.chunked_array(ids).combine_chunks(), np.concatenate(lengths), np.concatenate(rows), np.concatenate(codes)


class _Index:
    """A block's postings for the terms of a vocabulary.

    Ids whose terms weigh the same throughout score the same for every query, so they make a class, which keeps its
    k + 1 smallest ids: one of them may be the query's own. Term i has its classes, ascending, and what it weighs
    there but for its idf, from begin[i] to begin[i + 1]; class j has the places of its ids from first[j] to first[j + 1].
    """

    def __init__(self, files: list[tuple[str, int, int]], vocabulary: pa.Array, k: int, nulls: bool, average: float) -> None:
        ids, length, row, code = _read_block(files, vocabulary, nulls)
        distinct = ids.unique()
        self.ids = distinct.take(pc.array_sort_indices(distinct, null_placement="at_start"))
        place, v = pc.index_in(ids, value_set=self.ids).to_numpy().astype(np.int64), len(vocabulary)
        by_id = np.argsort(place, kind="stable")
        at = np.empty_like(by_id)
        at[by_id] = np.arange(len(by_id))
        posted, tf = np.unique(at[row] * v + code, return_counts=True)
        row, code = by_id[posted // v], posted % v
        weight, place = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / average)), place[row]
        if len(ids) > len(distinct):  # rows that repeat an id add up
            order = np.argsort(place * v + code, kind="stable")
            place, code, weight = place[order], code[order], weight[order]
            new = np.flatnonzero(np.diff(place * v + code, prepend=-1))
            place, code, weight = place[new], code[new], np.add.reduceat(weight, new) if len(new) else weight
        start = np.flatnonzero(np.diff(place, prepend=-1))
        met, count = place[start], np.diff(np.append(start, len(place)))
        leader = self._leaders(start, count, code, weight)
        leaders, of = np.unique(leader, return_inverse=True)
        self.class_of = np.full(len(self.ids), -1)
        self.class_of[met] = of
        members = np.argsort(of, kind="stable")
        self.size = np.bincount(of, minlength=len(leaders))
        least = np.arange(len(of)) - np.repeat(np.cumsum(self.size) - self.size, self.size) <= k
        self.members, self.first = met[members[least]], np.append(0, np.cumsum(np.minimum(self.size, k + 1)))
        lead = np.repeat(leader == np.arange(len(leader)), count)
        code, of, weight = code[lead], np.repeat(of, count)[lead], weight[lead]
        order = np.argsort(code, kind="stable")
        self.classes, self.weight = of[order], weight[order]
        self.begin = np.searchsorted(code[order], np.arange(v + 1))
        self.most, some = np.zeros(v), np.flatnonzero(np.diff(self.begin))
        if len(some):
            self.most[some] = np.maximum.reduceat(self.weight, self.begin[some])

    @staticmethod
    def _leaders(start: np.ndarray, count: np.ndarray, code: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For each id the first one with the same terms and weights: found by hashes, then compared."""
        if not len(start):
            return start
        mixed = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ weight.view(np.uint64)
        mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        _, first, alike = np.unique(np.add.reduceat(mixed ^ mixed >> np.uint64(32), start), return_index=True, return_inverse=True)
        leader = first[alike]
        other = np.minimum(np.arange(len(code)) + np.repeat(start[leader] - start, count), len(code) - 1)
        differs = np.logical_or.reduceat((code != code[other]) | (weight != weight[other]), start) | (count != count[leader])
        return np.where(differs, np.arange(len(start)), leader)

    def brings(self, term: int, worth: float, classes: np.ndarray) -> np.ndarray:
        d = self.classes[self.begin[term] : self.begin[term + 1]]
        at = np.minimum(np.searchsorted(d, classes), len(d) - 1)
        return np.where(d[at] == classes, worth * self.weight[self.begin[term] + at], 0.0)


def _best_of_block(index: _Index, codes: np.ndarray, worth: np.ndarray, ends: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """For each query of a part that meets a row: its number, the ids of its k best rows, and their whole scores; rows
    that can't reach its score in ``floor`` may be missing.

    Terms are added in the order of the most they can bring. Once all the others together can't bring as much as the
    k-th best sum so far, rows that have none of the terms so far are out, and so are, term by term, those that the
    others can't lift to that sum. What stays is scored anew, in the order of the query's terms; equal scores go by id.
    """
    sums = np.zeros(len(index.size))
    kth = lambda x, least: max(np.partition(x, -k)[-k], least) if len(x) >= k else least
    own_class = np.where(own >= 0, index.class_of[own], -1) if len(index.class_of) else own
    can_all = worth * index.most[codes]
    reach = np.add.reduceat(can_all, ends[:-1])
    for q in np.flatnonzero((reach > 0) & (reach >= floor - MARGIN)):
        can = can_all[ends[q] : ends[q + 1]]
        has = np.flatnonzero(can)
        c, w, can, least = codes[ends[q] + has], worth[ends[q] + has], can[has], floor[q]
        order = np.argsort(-can)
        left = np.append(np.cumsum(can[order][::-1])[::-1], 0.0)
        alone = own_class[q] if own_class[q] >= 0 and index.size[own_class[q]] == 1 else -1
        if alone >= 0:
            sums[alone] = -np.inf
        met, i = np.zeros(0, np.int64), 0
        for i, j in enumerate(order, 1):
            at = slice(index.begin[c[j]], index.begin[c[j] + 1])
            d = index.classes[at]
            had = sums[d]
            met = np.append(met, d[had == 0])
            sums[d] = had + w[j] * index.weight[at]
            if left[i] < max(left[0] - left[i], least) and kth(sums[met], least) - MARGIN > left[i]:
                break
        got = sums[met]
        sums[met] = 0
        if alone >= 0:
            sums[alone] = 0
        for j in [*order[i:], -1]:
            may = got + left[i] >= kth(got, least) - MARGIN
            met, got = met[may], got[may]
            if j >= 0:
                got, i = got + index.brings(c[j], w[j], met), i + 1
        met.sort()
        score = sum((index.brings(x, y, met) for x, y in zip(c, w, strict=True)), np.zeros(len(met)))
        rounded = np.round(score, 6)
        may = rounded >= kth(rounded, least)
        met, score, rounded = met[may], score[may], rounded[may]
        many = np.diff(index.first)[met]
        each = np.repeat(np.arange(len(met)), many)
        places = index.members[index.first[met][each] + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)]
        each, places = each[places != own[q]], places[places != own[q]]
        best = np.lexsort((places, -rounded[each]))[:k]
        if len(best):
            yield q, index.ids.take(pa.array(places[best])), score[each[best]]


def _best(asked: pa.Table, blocks: list[list[tuple[str, int, int]]], k: int, exclude_self: bool, average: float) -> pa.Table:
    """(query_id, id, score): of all rows of some blocks the k best of each query. What a query has already found
    tells what it needn't look at in the next block."""
    lists = asked["terms"].combine_chunks()
    terms, worth = lists.flatten().field("term"), lists.flatten().field("weight").to_numpy()
    vocabulary = terms.unique()
    codes, ends = pc.index_in(terms, value_set=vocabulary).to_numpy(), np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))
    found, floor = None, np.full(len(asked), -np.inf)
    for files in blocks:
        index = _Index(files, vocabulary, k, not exclude_self, average)
        own = pc.fill_null(pc.index_in(asked["own_id"].combine_chunks(), value_set=index.ids), -1).to_numpy() if exclude_self else np.full(len(asked), -1)
        got = list(_best_of_block(index, codes, worth, ends, own, floor, k))
        if got:
            q, ids, scores = zip(*got, strict=True)
            score = np.concatenate(scores)
            more = pa.table({"q": np.repeat(q, [len(x) for x in ids]), "id": pa.concat_arrays(ids), "score": score, "rounded": np.round(score, 6)})
            found = pa.concat_tables([found, more]) if found else more
            found = found.take(pc.sort_indices(found, [("q", "ascending"), ("rounded", "descending"), ("id", "ascending")], null_placement="at_start"))
            q = found["q"].to_numpy()
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            found, last = found.filter(pa.array(rank < k)), rank == k - 1
            floor[q[last]] = np.round(found["score"].to_numpy(), 6)[rank[rank < k] == k - 1]
    if found is None:
        return pa.table({"query_id": asked["query_id"][:0], "id": asked["own_id"][:0], "score": pa.array([], pa.float64())})
    return pa.table({"query_id": asked["query_id"].take(found["q"]), "id": found["id"], "score": found["score"]})


def _blocks(sizes: list[tuple[str, int]]) -> list[list[tuple[str, int, int]]]:
    """Files of so many terms as blocks of like sizes, BLOCK_TERMS at most, about: small files together, large ones in shares."""
    total, done, out = sum(n for _, n in sizes), 0.0, {}
    blocks = -(-total // BLOCK_TERMS)
    for path, n in sorted(sizes):
        shares = -(-n // BLOCK_TERMS)
        for share in range(shares):
            out.setdefault(int((done + n / shares / 2) * blocks / total), []).append((path, shares, share))
            done += n / shares
    return list(out.values())


def _scored(texts: DataFrame, stated: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """(query_id, id, score): from some blocks of ``texts`` together the k best rows of each query, with their whole scores."""
    spark, result = texts.sparkSession, StructType().add("query_id", stated.schema["query_id"].dataType).add("id", texts.schema["id"].dataType).add("score", DoubleType())
    known = F.when(F.col("length").isNotNull(), F.col("n"))
    per_file = texts.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.sum("n").alias("n"), F.sum(known).alias("known"), F.sum(F.col("length") * F.col("n")).alias("terms"), F.sum(F.when(F.col("length") > 0, F.size("t"))).alias("size")).collect()
    n, counted, all_terms = (sum(r[c] or 0 for r in per_file) for c in ("n", "known", "terms"))
    blocks, n_queries, average = _blocks([(r["path"], r["size"]) for r in per_file if r["size"]]), stated.count(), all_terms / (counted or 1)
    if not blocks:
        return spark.createDataFrame([], result)
    df = texts.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = stated.select("query_id", F.explode("t").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    terms = terms.join(df, "term").select("query_id", "term", (F.col("qtf") * inverse_frequency(F.lit(n), F.col("df"))).alias("weight"))
    asked = terms.where("weight > 0").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("terms"))
    asked = asked.where("query_id is not null") if exclude_self else asked
    parts = max(1, min(n_queries // LEAST_QUERIES, PAIRS // len(blocks)), -(-n_queries // BLOCK_QUERIES))
    asked = asked.select(F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"), "query_id", F.col("query_id").try_cast(texts.schema["id"].dataType).alias("own_id"), "terms")
    asked = stage(asked, "search-asked", by=["part"])
    files = {}
    for r in asked.select("part", F.col("_metadata.file_path").alias("path")).distinct().collect():
        files.setdefault(r["part"], []).append(r["path"])
    step = max(1, min(BLOCKS, len(blocks) * len(files) // PAIRS))
    tasks = [(part, first) for first in range(0, len(blocks), step) for part in sorted(files)]
    if not tasks:
        return spark.createDataFrame([], result)
    schema = to_arrow_schema(result)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number in (x for batch in batches for x in batch["id"].to_pylist()):
            part, first = tasks[number]
            read = []
            for path in files[part]:
                with open_shared(path) as file:
                    read.append(pq.ParquetFile(file).read())
            yield from _best(pa.concat_tables(read), blocks[first : first + step], k, exclude_self, average).cast(schema).to_batches()

    return spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(best, result)


def _scored_in_groups(corpus: DataFrame, queries: DataFrame, key: str, text: str, query_id: str, query_text: str, exclude_self: bool, group: str) -> DataFrame:
    """(query_id, id, score) of all rows that share a term with a query of their group."""
    posted, stats = postings(corpus, key, text), corpus_stats(corpus, text)
    weights = idf(posted, stats)
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(group).alias("_qg"), F.explode(search_terms(F.col(query_text))).alias("term"))
    asked = asked.groupBy("query_id", "_qg", "term").agg(F.count(F.lit(1)).alias("qtf")).join(weights, "term")
    posted = posted.join(corpus.select(F.col(key).alias("id"), F.col(group).alias("_g")).distinct(), "id")
    weigh = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    met = posted.join(asked, "term").where(F.col("_g").eqNullSafe(F.col("_qg")))
    met = met.where(F.col("id") != F.col("query_id")) if exclude_self else met
    return met.crossJoin(F.broadcast(stats)).groupBy("query_id", "id").agg(F.sum(weigh).alias("score"))  # stats is one row


def top_k(corpus: DataFrame, queries: DataFrame, k: int, key: str = "id", text: str = "question", query_id: str = "query_id", query_text: str = "question", exclude_self: bool = True, group: str | None = None) -> DataFrame:
    """(query_id, id, score, rank): for each query the k rows with the highest BM25 score, ties by id.

    Repeated query terms count repeatedly. Rows without a common term score 0 and are eligible after all others,
    by id; a blank query gets the first k ids. With ``exclude_self`` a row never answers the query of its own
    id; ``group`` restricts to rows that agree with the query in that column. Ranking uses scores rounded
    to 6 digits. Without ``group`` the pairs of rows and queries stay inside tasks, which return the k best of each
    query and block; with it, all pairs of a group that share a term are rows.
    """
    if k <= 0:
        return queries.select(F.col(query_id).alias("query_id"), F.lit(None).cast(corpus.schema[key].dataType).alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    if group:
        scored = _scored_in_groups(corpus, queries, key, text, query_id, query_text, exclude_self, group)
        ids, who = corpus.select(F.col(key).alias("id"), F.col(group).alias("_g")).distinct(), queries.select(F.col(query_id).alias("query_id"), F.col(group).alias("_qg")).distinct()
    else:
        texts = corpus.select(F.col(key).alias("id"), search_terms(F.col(text)).alias("t")).withColumn("length", F.when(F.col("t").isNotNull(), F.size("t")))
        # the first grouping brings an id's rows to one file; the second one needs no shuffle
        texts = texts.groupBy("id").agg(F.collect_list(F.struct("length", "t")).alias("x")).select("id", F.inline("x"))
        texts = texts.groupBy("id", "length").agg(F.flatten(F.collect_list("t")).alias("t"), F.count(F.lit(1)).alias("n"))
        texts = stage(texts.withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(2**31 - 1)).cast("int")), "search-texts")
        stated = stage(queries.select(F.col(query_id).alias("query_id"), search_terms(F.col(query_text)).alias("t")), "search-queries")
        scored = _scored(texts, stated, k, exclude_self)
        ids, who = texts.select("id").distinct(), stated.select("query_id").distinct()
    scored = scored.withColumn("score", F.round("score", 6))
    # rows that share no term: the k + 1 smallest ids (of the group) are enough to fill up
    by = Window.partitionBy(*(["_g"] if group else [])).orderBy("id")
    fill = (ids.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= k + 1) if group else ids.orderBy("id").limit(k + 1)).select("id", *(["_g"] if group else []))
    on = F.col("_g").eqNullSafe(F.col("_qg")) if group else F.lit(True)
    zero = who.join(F.broadcast(fill) if not group else fill, on)  # k + 1 rows
    zero = zero.where(F.col("id") != F.col("query_id")) if exclude_self else zero
    both = scored.unionByName(zero.select("query_id", "id", F.lit(0.0).alias("score"))).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
