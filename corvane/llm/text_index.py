"""Compressed full-text index of evaluation shards (problem 5).

The evaluation texts of a shard are one sequence of word symbols, a separator after each text. The index is that
sequence's compressed suffix array: per symbol the increasing places of the suffixes that follow it (the inverse of
the Burrows-Wheeler transform's ranks), on disk as packed differences, in memory one 32-bit number a symbol. A step of
backward search is a binary search in a symbol's part, done for all texts of a batch together. The text that a suffix
belongs to is found by walking on to a sampled suffix. Shards are of bounded size and written to the shared folder;
every task streams blocks of its training texts past each of them.

Pairs: with a bound t on the similarity, any partner of m words holds one of a text's n - a(n, m) + 1 rarest words,
a(n, m) being the words the two must share. The intervals of a block's words are located, so the texts behind the
rarest of them are the candidates and the merged counts of all of them the exact number of shared words. Spans: longer
backward steps give the maximal matches of a text per group of evaluation texts; they are merged to the spans that
recur word for word.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.words import BLANKS, strip, word_hashes
from corvane.llm.radix_groups import sql_key
from corvane.staging import open_shared, stage

#: Symbols a shard holds at most (a single longer text makes a shard of its own), symbols of training text that a task
#: holds while the shards pass, and candidate pairs looked at at once.
SHARD_SYMBOLS, HELD_SYMBOLS, AT_ONCE = 2_000_000, 2_000_000, 1_000_000
#: Every so many places of the texts the suffix is sampled; words of the shortest span.
SAMPLE, SPAN = 4, 5


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; ``text`` holds integers, the end sorts below all."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order, step = np.argsort(rank, kind="stable"), 1
    while n and step <= n:
        second = np.zeros(n, np.int64)
        second[:-step] = rank[step:] + 1
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        same = np.empty(n, np.int64)
        same[0] = 0
        same[1:] = np.cumsum(key[order][1:] != key[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = same
        if same[-1] == n - 1:
            break
        step *= 2
    return order


class TextIndex:
    """Compressed suffix array over texts given as flat 64-bit word hashes with offsets. Texts are kept in order of
    their number of distinct words; ``names`` may repeat."""

    def __init__(self, words: np.ndarray, offsets: np.ndarray, names: list[str]) -> None:
        docs = len(offsets) - 1
        sizes = np.array([len(np.unique(words[offsets[i] : offsets[i + 1]])) for i in range(docs)], np.int64)
        by_size = np.argsort(sizes, kind="stable")
        self.names = np.array([names[i] for i in by_size], object)
        self.sizes = sizes[by_size]
        self.vocabulary = np.unique(words)
        parts = [np.append(np.searchsorted(self.vocabulary, words[offsets[i] : offsets[i + 1]]) + 1, 0) for i in by_size]
        text = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
        order = suffix_array(text)
        n = len(text)
        row = np.empty(n, np.int64)
        row[order] = np.arange(n)
        self.psi = row[(order + 1) % max(1, n)].astype(np.int32)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.vocabulary) + 1))]).astype(np.int64)
        holder = np.repeat(np.arange(docs), [len(p) for p in parts])
        sampled = (order % SAMPLE == 0) | (text[order] == 0)
        self.sampled, self.holders = sampled, holder[order[sampled]].astype(np.int32)
        self._ready()

    def _ready(self) -> None:
        self.sample_rank = np.cumsum(self.sampled, dtype=np.int32) - self.sampled

    def dump(self) -> bytes:
        out = io.BytesIO()
        steps = np.diff(self.psi, prepend=0).astype(np.int32)
        np.savez(out, vocabulary=self.vocabulary, steps=steps, below=self.below, sampled=np.packbits(self.sampled), holders=self.holders, sizes=self.sizes, names=np.array([x.encode() for x in self.names], "S"))
        return zstandard.compress(out.getvalue())

    @classmethod
    def load(cls, blob: bytes) -> TextIndex:
        index = cls.__new__(cls)
        with np.load(io.BytesIO(zstandard.decompress(blob))) as z:
            index.vocabulary, index.below, index.holders, index.sizes = z["vocabulary"], z["below"], z["holders"], z["sizes"]
            index.psi = np.cumsum(z["steps"], dtype=np.int32)
            index.sampled = np.unpackbits(z["sampled"], count=len(index.psi)).view(bool)
            index.names = np.array([x.decode() for x in z["names"]], object)
        index._ready()
        return index

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """The words' symbols, 0 for words that no text holds."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), max(0, len(self.vocabulary) - 1))
        return np.where(self.vocabulary[at] == words, at + 1, 0) if len(self.vocabulary) else np.zeros(len(words), np.int64)

    def _seek(self, low: np.ndarray, high: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first row in [low, high) of a symbol's part whose suffix goes on at ``target`` or behind it."""
        low, high = low.copy(), high.copy()
        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) >> 1
            less = self.psi[middle] < target[live]
            low[live[less]] = middle[less] + 1
            high[live[~less]] = middle[~less]
            live = live[low[live] < high[live]]
        return low

    def step(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search by one symbol: the intervals of the suffixes that begin with it and go on in [low, high)."""
        begin, end = self.below[symbol], self.below[symbol + 1]
        first = self._seek(begin, end, low)
        return first, self._seek(first, end, high)

    def located(self, rows: np.ndarray) -> np.ndarray:
        """The texts that the suffixes of ``rows`` belong to."""
        rows = rows.astype(np.int64)
        live = np.flatnonzero(~self.sampled[rows])
        while len(live):
            rows[live] = self.psi[rows[live]]
            live = live[~self.sampled[rows[live]]]
        return self.holders[self.sample_rank[rows]].astype(np.int64)

    def listing(self, symbols: np.ndarray) -> np.ndarray:
        """Sorted symbol * number of texts + text, without repeats: the texts behind the intervals of the given symbols."""
        known = np.unique(symbols)
        known = known[known > 0]
        begin, width = self.below[known], self.below[known + 1] - self.below[known]
        at = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width - begin, width)
        return np.unique(np.repeat(known, width) * len(self.names) + self.located(at))

    def maximal_matches(self, symbols: np.ndarray, offsets: np.ndarray, least: int = 1, groups: list[np.ndarray] | None = None) -> np.ndarray:
        """For each group and each position of the flat texts, the length of the longest match that ends there, of at
        least ``least`` words. ``groups``: sorted rows of suffixes, by default one group of all."""
        first = np.repeat(offsets[:-1], np.diff(offsets))
        length = np.zeros((len(groups or [0]), len(symbols)), np.int64)
        live = np.flatnonzero(symbols > 0)
        low, high, at, k = self.below[symbols[live]], self.below[symbols[live] + 1], live.copy(), 1
        while len(live):
            if k >= least:
                for g, rows in enumerate(groups or [None]):
                    some = slice(None) if rows is None else np.searchsorted(rows, low) < np.searchsorted(rows, high)
                    length[g, live[some]] = k
            at = at - 1
            go = at >= first[live]
            go[go] = symbols[at[go]] > 0
            live, low, high, at = live[go], low[go], high[go], at[go]
            low, high = self.step(low, high, symbols[at])
            some = low < high
            live, low, high, at, k = live[some], low[some], high[some], at[some], k + 1
        return length

    def rows_by_name(self) -> dict[str, np.ndarray]:
        """The sorted rows of the suffixes of each name's texts."""
        of = self.located(np.arange(len(self.psi)))
        return {name: np.flatnonzero((self.names == name)[of]) for name in sorted(set(self.names))}

    def similar(self, words: np.ndarray, offsets: np.ndarray, t: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of (row, text, shared words) of all pairs of a similarity of at least t."""
        docs = len(self.names)
        if not docs or not len(words):
            return
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        order = np.lexsort((words, row))
        row, words = row[order], words[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (words[1:] != words[:-1])
        row, words = row[new], words[new]
        symbol = self.symbols(words)
        listing = self.listing(symbol)
        spread = np.where(symbol > 0, self.below[symbol + 1] - self.below[symbol], 0)
        order = np.lexsort((symbol, spread, row))
        row, symbol = row[order], symbol[order]
        count = np.bincount(row, minlength=len(offsets) - 1)
        start = np.cumsum(count) - count
        place, n = np.arange(len(row)) - start[row], count[row]
        p, q = t.numerator, t.denominator
        shortest = -(-n * p // q)  # a partner's fewest and most distinct words, if this is the first word they share
        longest = ((n - place) * (p + q)) // p - n
        low = np.searchsorted(self.sizes, shortest)
        high = np.searchsorted(self.sizes, longest, side="right")
        keep = (symbol > 0) & (high > low)
        row_s, sym_s, place_s = row[keep], symbol[keep], place[keep]
        a = np.searchsorted(listing, sym_s * docs + low[keep])
        b = np.searchsorted(listing, sym_s * docs + high[keep])
        width = b - a
        ends = np.cumsum(width)
        done = 0
        while done < len(width):  # blocks of a bounded number of candidates
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + AT_ONCE, side="right")))
            w, r = width[done:upto], row_s[done:upto]
            seed = np.repeat(np.arange(len(w)), w)
            at = np.arange(len(seed)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(a[done:upto], w)
            text = listing[at] % docs
            for k in range(0, len(seed), AT_ONCE):
                s, d = seed[k : k + AT_ONCE], text[k : k + AT_ONCE]
                yield self._verify(listing, r[s], place_s[done:upto][s], d, symbol, start, count, p, q)
            done = upto

    def _verify(self, listing: np.ndarray, row: np.ndarray, place: np.ndarray, text: np.ndarray, symbol: np.ndarray, start: np.ndarray, count: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count the shared words of each candidate; a pair counts at the rarest word it shares."""
        docs = len(self.names)
        shared = np.zeros(len(row), np.int64)
        live = np.arange(len(row))
        total = count[row] + self.sizes[text]
        k = 0
        while len(live):
            live = live[count[row[live]] > k]
            sym = symbol[start[row[live]] + k]
            key = sym * docs + text[live]
            at = np.minimum(np.searchsorted(listing, key), len(listing) - 1)
            has = (sym > 0) & (listing[at] == key)
            dup = has & (k < place[live])
            shared[live[has]] += 1
            k += 1
            most = shared[live] + count[row[live]] - k
            hopeful = ~dup & (most * (p + q) >= total[live] * p)
            shared[live[~hopeful]] = -1
            live = live[hopeful]
        good = (shared > 0) & (shared * (p + q) >= total * p)
        return row[good], text[good], shared[good]


def covered(length: np.ndarray) -> np.ndarray:
    """Mask of the positions in the matches that end at each position with the given lengths: the merged spans."""
    delta = np.zeros(len(length) + 1, np.int64)
    ends = np.flatnonzero(length > 0)
    np.add.at(delta, ends - length[ends] + 1, 1)
    np.add.at(delta, ends + 1, -1)
    return np.cumsum(delta[:-1]) > 0


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard per SHARD_SYMBOLS symbols of the task's texts."""
    words, names, held = [], [], 0

    def shard() -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        blob = TextIndex(np.concatenate(words), offsets, names).dump()
        return pa.RecordBatch.from_pydict({"kind": [kind], "shard": pa.array([blob], pa.binary())})

    kind = None
    for batch in batches:
        kinds = batch.column("kind").to_pylist()
        flat, offsets = _flat(batch.column("words"))
        for i, name in enumerate(batch.column("cls").to_pylist()):
            if held and (kinds[i] != kind or held + offsets[i + 1] - offsets[i] > SHARD_SYMBOLS):
                yield shard()
                words, names, held = [], [], 0
            kind = kinds[i]
            words.append(flat[offsets[i] : offsets[i + 1]].copy())
            names.append(name)
            held += int(offsets[i + 1] - offsets[i]) + 1
    if held:
        yield shard()


def build_index(texts: DataFrame, symbols: int | None = None) -> DataFrame:
    """Index ``texts`` (cls string, kind string, words array<bigint>) in shards: a written table (kind, shard).

    Texts are spread over tasks by their number of symbols, which one aggregate counts.
    """
    total = symbols or texts.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    parts = int(total // SHARD_SYMBOLS) + 1
    spread = texts.select("cls", "kind", "words").repartition(parts, "words").sortWithinPartitions("kind")
    return stage(spread.mapInArrow(_build, "kind string, shard binary"), "index")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The task's texts in blocks of HELD_SYMBOLS symbols."""
    held, symbols = [], 0
    for batch in batches:
        held.append(batch)
        symbols += len(batch.column("words").values)
        if symbols >= HELD_SYMBOLS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, symbols = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _shards(paths: list[str]) -> Iterator[tuple[str, TextIndex]]:
    import pyarrow.parquet as pq

    for path in paths:
        with open_shared(path) as file:
            table = pq.ParquetFile(file)
            for group in range(table.num_row_groups):
                for row in table.read_row_group(group).to_pylist():
                    yield row["kind"], TextIndex.load(row["shard"])


def _stream_pairs(paths: list[str], t: tuple[int, int]) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(b for b in batches if b.num_rows):
            kinds = np.array(block.column("kind").to_pylist(), object)
            parts = {}
            for kind in sorted(set(kinds)):
                part = block.take(pa.array(np.flatnonzero(kinds == kind))).combine_chunks().to_batches()[0]
                parts[kind] = (*_flat(part.column("words")), np.array(part.column("cls").to_pylist(), object))
            for kind, index in _shards(paths):
                if kind in parts:
                    flat, offsets, names = parts[kind]
                    for r, d, shared in index.similar(flat, offsets, Fraction(*t)):
                        yield pa.RecordBatch.from_pydict({"a": pa.array(names[r], pa.string()), "b": pa.array(index.names[d], pa.string()), "kind": pa.array([kind] * len(r), pa.string()), "shared": shared})

    return run


def _stream_spans(paths: list[str], least: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(b for b in batches if b.num_rows):
            (part,) = block.to_batches()
            flat, offsets = _flat(part.column("words"))
            row = np.repeat(np.arange(part.num_rows), np.diff(offsets))
            names = np.array(part.column("cls").to_pylist(), object)
            for _, index in _shards(paths):
                groups = index.rows_by_name()
                matches = index.maximal_matches(index.symbols(flat), offsets, least, list(groups.values()))
                for group, length in zip(groups, matches, strict=True):
                    at = np.flatnonzero(covered(length))
                    if len(at):
                        yield pa.RecordBatch.from_pydict({"cls": pa.array(names[row[at]], pa.string()), "grp": pa.array([group] * len(at), pa.string()), "place": at - offsets[row[at]], "match": length[at]})

    return run


def stream_index(texts: DataFrame, index: DataFrame, threshold: str = "0.7") -> DataFrame:
    """Pairs of ``texts`` (cls, kind, words) and indexed texts of the same kind with a word similarity of at
    least ``threshold``: (a, b, kind, shared). A task holds a block of its texts and one shard at a time."""
    t = Fraction(threshold)
    return texts.select("cls", "kind", "words").mapInArrow(_stream_pairs(index.inputFiles(), (t.numerator, t.denominator)), "a string, b string, kind string, shared bigint")


def stream_spans(texts: DataFrame, index: DataFrame, least: int = SPAN) -> DataFrame:
    """(cls, grp, spans, words, longest): the merged spans of ``texts`` (cls, words) that recur word for word, ``least``
    words or more at a time, among the indexed texts of each name; the words in them and the longest match."""
    found = texts.select("cls", "words").mapInArrow(_stream_spans(index.inputFiles(), least), "cls string, grp string, place bigint, match bigint")
    one = found.groupBy("cls", "grp", "place").agg(F.max("match").alias("match"))  # a group may stand in several shards
    places = one.groupBy("cls", "grp").agg(F.collect_set("place").alias("at"), F.max("match").alias("longest"))  # no more than the text's words
    begins = F.size(F.filter("at", lambda p: ~F.array_contains("at", p - 1)))
    return places.select("cls", "grp", begins.cast("bigint").alias("spans"), F.size("at").cast("bigint").alias("words"), "longest")


def sided_records(records: DataFrame) -> DataFrame:
    """(id, side, split, dataset_name, question, gold_sql): side "train" or "eval"; rows of another or no split are left out."""
    split = F.lower(strip(F.col("split")))
    side = F.when(split == "train", "train").when(split.isin("dev", "test", "held_out"), "eval")
    return records.select("id", side.alias("side"), split.alias("split"), "dataset_name", "question", "gold_sql").where("side is not null and id is not null").distinct()


def cross_split_matches(records: DataFrame, threshold: str = "0.7") -> tuple[DataFrame, DataFrame]:
    """(members, matches) of the two sides of ``records``: matches are pairs of text classes (a: train, b: evaluation),
    members (id, side, split, dataset_name, cls, kind) tells whose they are.

    Kind "q" is the question's word sequence, kind "s" the whole SQL key as a single symbol (no key for a
    blank gold_sql). Equal texts are one class, so copies are searched once.
    """
    sided = sided_records(records)
    blank = F.coalesce(F.col("gold_sql").rlike(f"^({BLANKS})?$"), F.lit(True))
    question = F.struct(F.lit("q").alias("kind"), word_hashes(F.col("question")).alias("words"))
    sql = F.struct(F.lit("s").alias("kind"), F.when(blank, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(sql_key(F.col("gold_sql"))))).alias("words"))
    both = sided.withColumn("x", F.explode(F.array(question, sql))).select("id", "side", "split", "dataset_name", "x.kind", "x.words").where(F.size("words") > 0)
    cls = F.md5(F.concat_ws(",", "kind", F.col("words").cast("array<string>")))
    members = stage(both.withColumn("cls", cls), "members")
    texts = lambda side: members.where(F.col("side") == side).dropDuplicates(["cls"]).select("cls", "kind", "words")
    found = stage(stream_index(texts("train"), build_index(stage(texts("eval"), "eval")), threshold), "matches")
    return members.drop("words"), found


def cross_split_pairs(records: DataFrame, threshold: str = "0.7") -> DataFrame:
    """(id_a, id_b), id_a < id_b: a train and an evaluation record with similar questions or the same SQL key."""
    members, found = cross_split_matches(records, threshold)
    train = members.where("side = 'train'").select(F.col("cls").alias("a"), F.col("id").alias("x"))
    other = members.where("side = 'eval'").select(F.col("cls").alias("b"), F.col("id").alias("y"))
    pairs = found.select("a", "b").join(train, "a").join(other, "b").where("x <> y")
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def cross_split_counts(records: DataFrame, threshold: str = "0.7") -> DataFrame:
    """(split, dataset_name, kind, n_records, n_leaked): evaluation records, and those of them with a partner in train, by kind of match."""
    members, found = cross_split_matches(records, threshold)
    leaked = found.select(F.col("b").alias("cls")).distinct().withColumn("hit", F.lit(1))
    evaluation = members.where("side = 'eval'").join(leaked, "cls", "left")
    return evaluation.groupBy("split", "dataset_name", "kind").agg(F.count_distinct("id").alias("n_records"), F.count_distinct(F.when(F.col("hit") == 1, F.col("id"))).alias("n_leaked"))


def cross_split_spans(records: DataFrame, least: int = SPAN) -> DataFrame:
    """(split, dataset_name, n_records, n_spans, n_words, longest): for each split and dataset of evaluation records, the
    training records (ids) with spans of ``least`` or more words of their question that recur in its questions, the
    number of these spans and of their words, and the longest match. Groups without any span have no row."""
    sided = sided_records(records).withColumn("words", word_hashes(F.col("question"))).where(F.size("words") > 0)
    group = F.to_json(F.struct("split", "dataset_name"))
    texts = sided.where("side = 'eval'").select(group.alias("cls"), F.lit("q").alias("kind"), "words").distinct()
    index = build_index(stage(texts, "eval"))
    train = stage(sided.where("side = 'train'").select("id", F.md5(F.concat_ws(",", F.col("words").cast("array<string>"))).alias("cls"), "words"), "train")
    found = stream_spans(train.dropDuplicates(["cls"]), index, least)
    copies = train.groupBy("cls").agg(F.count_distinct("id").alias("c"))
    of_group = F.from_json("grp", "split string, dataset_name string")
    totals = found.join(copies, "cls").groupBy("grp").agg(F.sum("c").alias("n_records"), F.sum(F.col("spans") * F.col("c")).alias("n_spans"), F.sum(F.col("words") * F.col("c")).alias("n_words"), F.max("longest").alias("longest"))
    return totals.select(of_group["split"].alias("split"), of_group["dataset_name"].alias("dataset_name"), "n_records", "n_spans", "n_words", "longest")
