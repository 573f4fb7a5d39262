"""Evaluation texts leaking into training text (problem 8): a distributed positional inverted index.

The index is partitioned by document and written once: each task turns its documents into the postings (term ->
positions) of one shard per batch; positions are global to the shard, documents are set apart by a gap. Terms are those
of the evaluation texts, whose number grows far slower than the texts. For phrases alone, postings are kept in runs of
at least ``span`` consecutive such terms, since a shared passage is a run of that kind; for proximity all are kept,
since an edited word may break the run. Corpus frequencies of the terms are then summed over all shards, and every
window of ``span`` words of an evaluation text is answered from its rarest terms: their positions, shifted to the
window's start, are intersected with the shifted positions of the next rarest term, and so on. For a phrase every
term must stand at its place; for proximity all but ``missing`` of them must stand at most ``slop`` words out of place.
No text or posting is shuffled; only terms, their counts and matches are.

The evaluation texts are the stated query set. They are looked up in blocks of at most ``BLOCK_WORDS`` words, so that
what the tasks hold of them is bounded; all blocks read the same index.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.staging import stage

#: Words of evaluation text that are searched for at once.
BLOCK_WORDS = 500_000
#: Window positions that are looked up at once.
AT_ONCE = 1_000_000
#: Words of a shard after which the next one begins.
SHARD_WORDS = 4_000_000

WORD = re.compile(r"[^\W_]+")
SHARD = "terms binary, shard binary"
MATCH = "doc_id bigint, item_id bigint, match_type string, n_words bigint, doc_word bigint, item_word bigint"


def text_words(text: str) -> list[str]:
    """The longest runs of letters and digits of the lower-cased text."""
    return WORD.findall(text.lower())


def _runs(known: np.ndarray, span: int) -> np.ndarray:
    """Mask of the positions in runs of at least ``span`` true values."""
    edge = np.diff(np.concatenate([[0], known.view(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - begin >= span
    mark = np.zeros(len(known) + 1, np.int32)
    np.add.at(mark, begin[long], 1)
    np.add.at(mark, end[long], -1)
    return np.cumsum(mark[:-1]) > 0


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = {w for text in batch.column(0).to_pylist() for w in text_words(text)}
        yield pa.RecordBatch.from_pydict({"term": pa.array(sorted(found), pa.string())})


def _post(shared: Broadcast, span: int, slop: int) -> object:
    """Postings of the task's documents: one row per shard. No window reaches over the gap between two documents."""

    def shard(ids: list[int], coded: list[np.ndarray]) -> pa.RecordBatch:
        lengths = np.array([len(c) for c in coded], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths + span + slop)[:-1]]).astype(np.int64)
        flat = np.concatenate(coded)
        at = np.arange(len(flat)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
        kept = flat >= 0
        if not slop:
            padded = np.zeros(int(starts[-1] + lengths[-1]) if len(lengths) else 0, bool)
            padded[at] = kept
            kept = _runs(padded, span)[at]
        terms, positions = flat[kept], at[kept]
        order = np.argsort(terms, kind="stable")
        terms, positions = terms[order], positions[order]
        names, counts = np.unique(terms, return_counts=True)
        packed = _pack(names=names.astype(np.int32), counts=counts.astype(np.int32), positions=positions.astype(np.int32), ids=np.array(ids, np.int64), starts=starts)
        return pa.RecordBatch.from_pydict({"terms": pa.array([_pack(names=names.astype(np.int32), counts=counts.astype(np.int32))], pa.binary()), "shard": pa.array([packed], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, coded, held = [], [], 0
        get = shared.value.get
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key is None or text is None:
                    continue
                found = text_words(text)
                if len(found) < span:
                    continue
                ids.append(key)
                coded.append(np.array([get(w, -1) for w in found], np.int32))
                held += len(found)
                if held > SHARD_WORDS:
                    yield shard(ids, coded)
                    ids, coded, held = [], [], 0
        if ids:
            yield shard(ids, coded)

    return run


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            with np.load(io.BytesIO(blob)) as z:
                yield pa.RecordBatch.from_pydict({"term": z["names"], "n": z["counts"].astype(np.int64)})


class Windows:
    """All windows of ``span`` words of the query texts, each with its words from the rarest on.

    ``rare``: the distinct sets of the ``most`` rarest terms of a window, with their places relative to the first one;
    ``members`` (from ``first_member`` on, ``sizes`` many): the windows of each. Neighbouring windows mostly share theirs.
    """

    def __init__(self, items: np.ndarray, flat: np.ndarray, offsets: np.ndarray, counts: np.ndarray, span: int, slop: int, missing: int) -> None:
        begin = np.repeat(offsets[:-1], np.maximum(0, np.diff(offsets) - span + 1))
        which = np.repeat(np.arange(len(items)), np.maximum(0, np.diff(offsets) - span + 1))
        first = np.arange(len(begin)) - np.searchsorted(which, which)
        words = flat[(begin + first)[:, None] + np.arange(span)]
        possible = (counts[words] > 0).sum(axis=1) >= span - missing
        words, self.item, self.first = words[possible], items[which[possible]], first[possible]
        self.shift = np.argsort(counts[words], axis=1, kind="stable").astype(np.int32)
        self.terms = np.take_along_axis(words, self.shift, axis=1)
        self.most = min(span, missing + 2 if slop else 1)
        key = np.hstack([self.terms[:, : self.most], self.shift[:, : self.most] - self.shift[:, :1]]) if slop else np.arange(len(words))[:, None]
        _, at, group = np.unique(key, axis=0, return_index=True, return_inverse=True)
        self.rare, self.gaps = self.terms[at, : self.most], (self.shift[at, : self.most] - self.shift[at, :1]).astype(np.int64)
        self.members = np.argsort(group.reshape(-1), kind="stable")
        self.sizes = np.bincount(group.reshape(-1), minlength=len(at))
        self.first_member = np.cumsum(self.sizes) - self.sizes


_LAST: list[tuple[object, Windows]] = []


def _windows(shared: Broadcast, span: int, slop: int, missing: int) -> Windows:
    """The block's windows, made once per Python worker; only the last block's are kept."""
    if not _LAST or _LAST[0][0] is not shared.value:
        _LAST[:] = [(shared.value, Windows(*shared.value, span, slop, missing))]
    return _LAST[0][1]


def _near(term_at: np.ndarray, place: np.ndarray, term: np.ndarray, slop: int) -> np.ndarray:
    """Whether the term stands at most ``slop`` words from the place."""
    hit = term_at[place] == term
    for d in range(1, slop + 1):
        hit |= (term_at[place - d] == term) | (term_at[place + d] == term)
    return hit


def _search(shared: Broadcast, span: int, slop: int, missing: int) -> object:
    """Matches of the windows in the task's shards: phrase matches, merged to spans; proximity matches if slop > 0."""
    # no word that is looked up lies further from its anchor
    reach = span + slop + 1

    def spans(kind: str, windows: Windows, ids: np.ndarray, starts: np.ndarray, window: np.ndarray, at: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        item, diagonal = windows.item[window], at - windows.first[window]
        order = np.lexsort((at, diagonal, item, doc))
        doc, item, diagonal, at, first = doc[order], item[order], diagonal[order], at[order], windows.first[window][order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (at[1:] > at[:-1] + 1)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(doc))[: len(begin)]
        size = at[end - 1] - at[begin] + span if len(begin) else np.zeros(0, np.int64)
        place = np.maximum(0, at[begin] - starts[doc[begin]])
        return pa.RecordBatch.from_pydict({"doc_id": ids[doc[begin]], "item_id": item[begin], "match_type": pa.array([kind] * len(begin), pa.string()), "n_words": size.astype(np.int64), "doc_word": place.astype(np.int64), "item_word": first[begin].astype(np.int64)})

    def places(windows: Windows, names: np.ndarray, counts: np.ndarray, positions: np.ndarray, term_at: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of (set of rare terms, place of its rarest term, position of its k-th term, which stands there) with
        enough of the set's terms near their places."""
        begin = np.cumsum(counts) - counts
        term = windows.rare[:, k]
        slot = np.minimum(np.searchsorted(names, term), len(names) - 1)
        have = np.flatnonzero(names[slot] == term)
        width = counts[slot[have]].astype(np.int64)
        total = np.cumsum(width)
        done = 0
        while done < len(have):
            upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + AT_ONCE, side="right")))
            w, lists = width[done:upto], slot[have[done:upto]]
            group = np.repeat(have[done:upto], w)
            anchor = positions[np.repeat(begin[lists] - np.cumsum(w) + w, w) + np.arange(len(group))].astype(np.int64)
            done = upto
            base, misses = anchor - windows.gaps[group, k], np.zeros(len(group), np.int64)
            for other in range(windows.most):
                if other != k:
                    misses += ~_near(term_at, base + windows.gaps[group, other] + reach, windows.rare[group, other], slop)
                    left = misses <= missing
                    group, anchor, base, misses = group[left], anchor[left], base[left], misses[left]
            yield group, base, anchor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(shared, span, slop, missing)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                with np.load(io.BytesIO(blob)) as z:
                    names, counts, positions, ids, starts = (z[k] for k in ("names", "counts", "positions", "ids", "starts"))
                if not len(names) or not len(windows.item):
                    continue
                # the inverse of the postings: membership of a shifted position in a term's list is one look-up
                term_at = np.full(int(positions.max()) + 4 * reach + 1, -1, np.int32)
                term_at[positions + 2 * reach] = np.repeat(names, counts)
                shifted = term_at[reach:]
                # of a window with at most so many terms missing, one of the missing + 1 rarest stands near its place
                found = [x for k in range(min(missing, windows.most - 1) + 1) for x in places(windows, names, counts, positions, shifted, k)]
                group, base, anchor = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
                _, one = np.unique(np.stack([group, base]), axis=1, return_index=True)
                group, base, anchor = group[one], base[one], anchor[one]
                many = windows.sizes[group]
                window = windows.members[np.repeat(windows.first_member[group] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))]
                base, anchor = np.repeat(base, many), np.repeat(anchor, many)
                at, misses, exact = base - windows.shift[window, 0], np.zeros(len(window), np.int64), np.ones(len(window), bool)
                for k in range(span):
                    place = at + windows.shift[window, k] + reach
                    here = shifted[place] == windows.terms[window, k]
                    misses += ~(_near(shifted, place, windows.terms[window, k], slop) if slop else here)
                    left = misses <= missing
                    exact &= here
                    window, at, anchor, misses, exact = window[left], at[left], anchor[left], misses[left], exact[left]
                doc = np.searchsorted(starts, anchor, side="right") - 1
                if exact.any():
                    yield spans("phrase", windows, ids, starts, window[exact], at[exact], doc[exact])
                if slop and len(window):
                    yield spans("proximity", windows, ids, starts, window, at, doc)

    return run


def passage_matches(documents: DataFrame, passages: DataFrame, span: int = 12, slop: int = 0, missing: int = 1, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, match_type, n_words, doc_word, item_word): runs of words that a document shares
    with an evaluation text.

    "phrase": at least ``span`` consecutive words in both, runs merged to their full length. With ``slop`` > 0 also
    "proximity": a window of ``span`` words of the evaluation text, aligned so that one of its missing + 1 rarest words
    stands in the document, of which all but at most ``missing`` words stand at most ``slop`` words out of place; phrases
    are among them. Texts shorter than ``span`` words and null texts or ids match nothing; equal documents under two ids
    both match.
    """
    spark = documents.sparkSession
    missing = missing if slop else 0
    items = passages.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text")).where("item_id is not null and text is not null").distinct()
    terms = [r["term"] for r in items.select("text").mapInArrow(_terms, "term string").distinct().collect()]
    vocabulary = {w: i for i, w in enumerate(sorted(terms))}
    docs = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    index = stage(docs.mapInArrow(_post(spark.sparkContext.broadcast(vocabulary), span, slop), SHARD), "postings")
    counts = np.zeros(len(vocabulary) + 1, np.int64)
    for r in index.select("terms").mapInArrow(_count_terms, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        counts[r["term"]] = r["n"]
    weight = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = int(weight // (4 * BLOCK_WORDS)) + 1
    out = None
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        coded = [(r["item_id"], np.array([vocabulary[w] for w in text_words(r["text"])], np.int32)) for r in sorted(part.collect())]
        offsets = np.cumsum([0, *(len(c) for _, c in coded)])
        told = (np.array([k for k, _ in coded], np.int64), np.concatenate([np.zeros(0, np.int32), *(c for _, c in coded)]), offsets, counts)
        found = index.select("shard").mapInArrow(_search(spark.sparkContext.broadcast(told), span, slop, missing), MATCH)
        out = found if out is None else out.union(found)
    return out.select(F.col("doc_id"), "item_id", "match_type", "n_words", "doc_word", "item_word")


def leaked_items(documents: DataFrame, passages: DataFrame, span: int = 12) -> DataFrame:
    """(doc_id, item_id): documents that share at least ``span`` consecutive words with an evaluation text."""
    return passage_matches(documents, passages, span).select("doc_id", "item_id").distinct()
