"""Duplicates hidden by formatting (problem 6): recursive radix partitioning on canonical bytes, counted in tries.

1. Every task first counts its own rows in tries, so a text with a third of all copies leaves each task as
   one entry.
2. The entries are partitioned by their leading bytes. Buckets of more than ``BUCKET_KEYS`` entries or
   ``BUCKET_BYTES`` bytes of keys are split by further bytes, again and again, until each fits; what can't be split
   further is a single key. Only the oversized buckets are read in the next round; their prefixes stand in a table.
3. Each bucket is counted in one trie with terminal counters, bucket after bucket within a task.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.staging import stage

#: Bytes of the first partitioning and those added by the first split.
FIRST_BYTES, MORE_BYTES = 2, 4
#: Keys, and bytes of keys, that a task's trie holds before it hands them on, and that a bucket may have.
BUCKET_KEYS, BUCKET_BYTES = 50_000, 64_000_000
#: Characters of the SQL key besides letters and digits.
SQL_SIGNS = "<>=!+-*/%"

ENTRY = "key binary, n bigint, least string"


def question_key(question: Column) -> Column:
    """Lower case with only letters and digits; empty for null."""
    return F.coalesce(F.regexp_replace(F.lower(question), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def sql_key(sql: Column) -> Column:
    """Lower case with only letters, digits and the signs < > = ! + - * / %; empty for null."""
    return F.coalesce(F.regexp_replace(F.lower(sql), r"[^\p{L}\p{N}<>=!+\-*/%]+", ""), F.lit(""))


def parsed_payloads(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """(example_id, question, db_id, schema_context, gold_sql, difficulty) of the JSON records of ``raw``.

    Lines that are cut off, blank or no JSON object are no records; missing keys are null.
    """
    fields = "example_id string, question string, db_id string, schema_context string, gold_sql string, difficulty string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"}
    record = F.from_json(F.col(payload), f"{fields}, _bad string", options)
    return raw.where(F.col(payload).rlike(r"^\s*\{")).select(record.alias("r")).where("r is not null and r._bad is null").select("r.*").drop("_bad")


class KeyTrie:
    """Path-compressed trie over byte strings; a terminal holds the number of copies and the least id."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]
        self.keys = self.size = 0

    def add(self, key: bytes, n: int, least: str | None) -> None:
        """A node is [label, children by first byte, terminal]; terminal is None or [n, least]."""
        node, at = self.root, 0
        while at < len(key):
            below = node[1].get(key[at])
            if below is None:
                node[1][key[at]] = [key[at:], {}, [n, least]]
                self._grown(key)
                return
            label = below[0]
            if not key.startswith(label, at):
                same = len(os.path.commonprefix([label, key[at : at + len(label)]]))
                below[:] = [label[:same], {label[same]: [label[same:], below[1], below[2]]}, None]
            node, at = below, at + len(below[0])
        if node[2] is None:
            node[2] = [n, least]
            self._grown(key)
            return
        node[2][0] += n
        if least is not None and (node[2][1] is None or least < node[2][1]):
            node[2][1] = least

    def _grown(self, key: bytes) -> None:
        self.keys += 1
        self.size += len(key)

    def full(self) -> bool:
        return self.keys >= BUCKET_KEYS or self.size >= BUCKET_BYTES

    def entries(self) -> Iterator[tuple[bytes, int, str | None]]:
        stack = [(b"", self.root)]
        while stack:
            head, (label, children, end) = stack.pop()
            if end is not None:
                yield head + label, end[0], end[1]
            stack.extend((head + label, e) for e in children.values())


def _frame(trie: KeyTrie) -> pd.DataFrame:
    return pd.DataFrame(list(trie.entries()), columns=["key", "n", "least"])


def _count_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    trie = KeyTrie()
    for pdf in batches:
        for key, n, least in zip(pdf["key"], pdf["n"], pdf["least"], strict=True):
            trie.add(bytes(key), int(n), least)
            if trie.full():
                yield _frame(trie)
                trie = KeyTrie()
    if trie.keys:
        yield _frame(trie)


def _count_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by bucket."""
    trie, bucket = KeyTrie(), None
    for pdf in batches:
        done = []
        for b, key, n, least in zip(pdf["bucket"], pdf["key"], pdf["n"], pdf["least"], strict=True):
            if b != bucket:
                if trie.keys:
                    done.append(_frame(trie))
                trie, bucket = KeyTrie(), b
            trie.add(bytes(key), int(n), least)
        if done:
            yield pd.concat(done)
    if trie.keys:
        yield _frame(trie)


def _shared_bytes(first: pd.Series, last: pd.Series) -> pd.Series:
    return pd.Series([len(os.path.commonprefix([bytes(a), bytes(b)])) for a, b in zip(first, last, strict=True)], dtype="int32")


def radix_buckets(entries: DataFrame) -> DataFrame:
    """Add ``bucket`` (binary): the leading bytes of ``key`` at the depth where its bucket fits.

    A bucket fits with at most BUCKET_KEYS entries and BUCKET_BYTES bytes of keys, or if it holds one key only. A
    larger one is split behind the bytes that all its keys share, by twice as many bytes in each round, so the number
    of rounds grows with the logarithm of the longest key. ``entries`` must be a written table.
    """
    shared = F.pandas_udf(_shared_bytes, "int")
    rest, placed, more = entries.withColumn("bucket", F.substring("key", 1, FIRST_BYTES)), None, MORE_BYTES
    while True:
        counts = rest.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.sum(F.length("key")).alias("size"), F.min("key").alias("first"), F.max("key").alias("last"))
        large = counts.where(((F.col("c") > BUCKET_KEYS) | (F.col("size") > BUCKET_BYTES)) & (F.col("first") != F.col("last")))
        large = stage(large.select("bucket", (F.greatest(shared("first", "last"), F.length("bucket")) + more).alias("depth")), "oversized")
        if large.isEmpty():
            return rest if placed is None else placed.unionByName(rest)
        fitting = rest.join(large, "bucket", "left_anti")
        placed = fitting if placed is None else placed.unionByName(fitting)
        rest = stage(rest.join(large, "bucket").withColumn("bucket", F.expr("substring(key, 1, depth)")).select(*placed.columns), "split")
        more *= 2


def count_copies(keyed: DataFrame) -> DataFrame:
    """(key, n, least) for ``keyed`` (key binary, least string): copies per key and the least id, null ids last.

    Ids compare as byte strings. Keys may be empty, of any bytes and length; an empty table gives no rows.
    """
    local = stage(keyed.select("key", F.lit(1).cast("bigint").alias("n"), "least").mapInPandas(_count_rows, ENTRY), "tries")
    placed = radix_buckets(local)
    return placed.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "key", "n", "least").mapInPandas(_count_buckets, ENTRY)


def formatting_copies(records: DataFrame, raw: DataFrame) -> DataFrame:
    """(example_id, n_copies) for every set of rows of both tables that agree in question and SQL key.

    Every row counts, repeats included. A null question or SQL has the empty key.
    """
    both = records.select("example_id", "question", "gold_sql").unionByName(parsed_payloads(raw).select("example_id", "question", "gold_sql"))
    key = F.encode(F.concat(question_key(F.col("question")), F.lit("\x01"), sql_key(F.col("gold_sql"))), "UTF-8")
    counted = count_copies(both.select(key.alias("key"), F.col("example_id").alias("least")))
    return counted.select(F.col("least").alias("example_id"), F.col("n").alias("n_copies"))
