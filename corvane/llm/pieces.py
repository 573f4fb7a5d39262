"""Splitting oversized items at natural boundaries (problem 10): structure-tree packing.

A text is parsed into a tree: sections nested by the rank of their headings, blocks, list items nested by their
indent, lines, sentences, clauses, words, characters. Inside a code fence only its lines and blank lines count. Each
place between two tokens has the level of the strongest boundary there; the places of the strongest level inside a node
cut it into its children. Sizes are sums over the text's own tokens, computed once per text for all limits. Packing
starts at the root: a node's children are merged with their following siblings as long as the limit allows, only a
child that is itself too large is descended into, and no piece joins the children of two parents. Each piece but the
first begins ``overlap`` tokens before the end of the previous one.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.tokens import VOCABULARY, encode, token_bytes

#: Levels of boundaries from the strongest on; items by the depth of their list.
LEVELS = ("h1", "h2", "h3", "h4", "h5", "h6", "block", "item 1", "item 2", "item 3", "item 4", "line", "sentence", "clause", "word", "character")
BLOCK, ITEM, INNER, LINE, CHARACTER = LEVELS.index("block"), LEVELS.index("item 1"), LEVELS.index("item 4"), LEVELS.index("line"), len(LEVELS) - 1
#: Lines of headings, fences, table rows, block markup and list items (indent and mark).
HEADING = re.compile(rb"(?:(#{1,6})[ \t]|<h([1-6])[ >])")
FENCE = re.compile(rb" {0,3}(```+|~~~+)([^\r\n]*)")
MARKUP = re.compile(rb"<(?:p|ul|ol|table|div|section|pre)[ >]")
LIST_ITEM = re.compile(rb"([ \t]*)(?:[-*+]|\d{1,4}[.)]|<li>|<tr>)[ \t]*\S")
EMPTY = re.compile(rb"[ \t]*(?:[\r\n]|\Z)")
PLAIN, HEAD, CODE, TABLE, LISTED, MARKED, INDENTED = range(7)


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


#: First bytes of lines that may be more than a line; closing marks of sentences and clauses, the wide ones by their UTF-8 bytes.
SPECIAL, GAP, SENTENCE_END, CLAUSE_END = _table(b"#<`~|-*+0123456789 \t"), _table(b" \t"), _table(b".!?;"), _table(b",:")
WIDE_SENTENCE_END, WIDE_CLAUSE_END = ("。", "！", "？", "；"), ("，", "、", "：")
#: Tokens at each end of a piece that a cut may change; bytes of text that are analysed together.
EDGE, TOGETHER = 6, 4_000_000
PIECE = "limit_id int, piece_no int, n_tokens int, overlap_tokens int, boundary string, piece string"


def _line_levels(raw: bytes, lines: np.ndarray, first: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(level, empty) of the lines that begin at the byte places ``lines``; ``texts``: where texts begin in ``raw``."""
    byte_empty = (first == 10) | (first == 13)
    empty, level, kind = byte_empty.copy(), np.full(len(lines), LINE, np.int8), np.full(len(lines), PLAIN, np.int8)
    special = np.flatnonzero(SPECIAL[first])
    owner = np.searchsorted(texts, lines[special], side="right")
    fences: list[tuple[int, int]] = []  # lines of the opening and of the one after the closing
    opened, mark, of = -1, b"", 0
    text_end = lambda o: int(np.searchsorted(lines, texts[o])) if o < len(texts) else len(lines)
    for k, o in zip(special.tolist(), owner.tolist(), strict=True):
        at = int(lines[k])
        if opened >= 0 and o != of:  # a fence ends with its text
            fences.append((opened, text_end(of)))
            opened = -1
        if EMPTY.match(raw, at):
            empty[k] = True
            continue
        fence = FENCE.match(raw, at)
        if opened >= 0:
            if fence and fence.group(1).startswith(mark) and not fence.group(2).strip():
                fences.append((opened, k + 1))
                opened = -1
            continue
        if fence:
            opened, mark, of = k, fence.group(1), o
            continue
        if heading := HEADING.match(raw, at):
            kind[k], level[k] = HEAD, len(heading.group(1)) - 1 if heading.group(1) else int(heading.group(2)) - 1
        elif raw[at] == 0x7C:
            kind[k] = TABLE
        elif item := LIST_ITEM.match(raw, at):
            kind[k], level[k] = LISTED, ITEM + min(3, len(item.group(1).expandtabs(4)) // 2)
        elif MARKUP.match(raw, at):
            kind[k], level[k] = MARKED, BLOCK
        elif raw[at] in b" \t":
            kind[k] = INDENTED
    if opened >= 0:
        fences.append((opened, text_end(of)))
    full = np.flatnonzero(~empty)
    after_blank = np.concatenate([[False], empty[:-1]]) if len(empty) else empty
    before = np.full(len(lines), PLAIN, np.int8)  # the kind of the last line that isn't empty
    before[full[1:]] = kind[full[:-1]]
    in_list = (before == LISTED) | (before == INDENTED)
    level[(kind == TABLE) & ((before != TABLE) | after_blank)] = BLOCK
    level[after_blank & (kind == PLAIN)] = BLOCK
    level[after_blank & (kind == INDENTED)] = np.where(in_list[after_blank & (kind == INDENTED)], INNER, BLOCK)
    level[after_blank & (kind == LISTED) & ~in_list] = BLOCK
    for begin, end in fences:
        level[begin + 1 : end] = np.where(after_blank[begin + 1 : end], INNER, LINE)
        level[begin] = min(level[begin], BLOCK)
        if end < len(level):
            level[end] = min(level[end], BLOCK)
    return level, empty


def boundaries(raw: bytes, texts: np.ndarray) -> list[np.ndarray]:
    """Per level from h1 to word, the byte places where a piece may begin. ``texts``: where the texts begin in ``raw``."""
    byte = np.frombuffer(raw, np.uint8)
    none = np.zeros(0, np.int64)
    if not len(byte):
        return [none] * CHARACTER
    newline, back = byte == 10, byte == 13
    back[:-1] &= ~newline[1:]  # of a pair the second byte ends the line
    lines = np.flatnonzero(newline | back) + 1
    lines = lines[lines < len(byte)]
    level, empty = _line_levels(raw, lines, byte[lines], texts)
    lines, level = lines[~empty], level[~empty]
    gap = GAP[byte]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1  # a word begins after the blanks
    runs = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1
    runs = np.concatenate([[0], runs]) if gap[0] else runs
    before = byte[np.maximum(runs[: len(starts)] - 1, 0)]
    sentence, clause = starts[SENTENCE_END[before]], starts[CLAUSE_END[before]]
    if (byte >= 0xE3).any():
        wide = lambda marks: np.array([m.end() for m in re.finditer("|".join(marks).encode(), raw)], np.int64)
        sentence, clause = np.union1d(sentence, wide(WIDE_SENTENCE_END)), np.union1d(clause, wide(WIDE_CLAUSE_END))
    return [*(lines[level == k] for k in range(LINE + 1)), sentence, clause, starts]


class Text:
    """A text with its token places and, per level, the places (in tokens) where it may be cut."""

    def __init__(self, raw: bytes, ends: np.ndarray, whole: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, int, int]], vocabulary: str) -> None:
        self.raw, self.ends, self.n, self.vocabulary = raw, ends, len(ends) - 1, vocabulary
        self.whole = np.flatnonzero(whole)  # places between characters
        self._levels, self._lists = levels, {}

    def cuts(self, level: int) -> list[int]:
        if level not in self._lists:
            if level < CHARACTER:
                at, cut, i, first = self._levels[level]
                places = at[cut[i] : cut[i + 1]] - first
            else:
                places = self.whole
            self._lists[level] = places[(places > 0) & (places < self.n)].tolist()
        return self._lists[level]

    def slice(self, begin: int, end: int) -> str:
        return self.raw[self.ends[begin] : self.ends[end]].decode("utf-8", "surrogatepass")

    def size(self, begin: int, end: int) -> int:
        """Tokens of the piece by itself. Words are encoded one by one, so only what stands at its two ends can
        change; where these ends hold no blank, the whole piece is encoded."""
        head = int(self.whole[np.searchsorted(self.whole, min(begin + EDGE, end))])
        tail = self.char_place(max(end - EDGE, begin))
        inner = lambda a, b: b" " in self.raw[self.ends[a] + 1 : self.ends[b]]
        if tail <= head or (begin and not inner(begin, head)) or (end < self.n and not inner(tail, end)):
            return len(encode(self.slice(begin, end), self.vocabulary))
        first = len(encode(self.slice(begin, head), self.vocabulary)) if begin else head - begin
        last = len(encode(self.slice(tail, end), self.vocabulary)) if end < self.n else end - tail
        return tail - head + max(first, head - begin) + max(last, end - tail)

    def char_place(self, at: int) -> int:
        """The last place not after ``at`` that lies between characters."""
        return int(self.whole[np.searchsorted(self.whole, at, side="right") - 1])


def pack(text: Text, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(begin, end, boundary) of the pieces, in tokens; ``boundary`` is the level of the cut at the end.

    A heading, or what else stands before the first child, goes with that child if the two don't fit a piece. The
    first piece has at least ``overlap`` tokens.
    """
    out: list[tuple[int, int, str]] = []
    begin = 0

    def take(end: int, boundary: str) -> None:
        nonlocal begin
        if out or end >= overlap or end == text.n:
            out.append((begin, end, boundary))
            begin = text.char_place(end - overlap)

    def fits(end: int) -> bool:
        return end - begin <= limit and text.size(begin, end) <= limit

    def descend(a: int, b: int, level: int, boundary: str) -> None:
        """Pack the node [a, b), which may have children from ``level`` on."""
        while level <= CHARACTER:
            cuts = text.cuts(level)
            i, j = bisect_right(cuts, a), bisect_left(cuts, b)
            if i < j:
                break
            level += 1
        else:
            take(b, boundary)
            return
        head, at = i, a
        while True:
            if fits(b):
                take(b, boundary)
                return
            k = bisect_right(cuts, begin + limit, i, j) - 1
            while k >= i and not fits(cuts[k]):
                k -= 1
            if k == i == head and cuts[k] - begin <= limit // 4 and (cuts[k + 1] if k + 1 < j else b) - cuts[k] > limit - overlap:
                at, i = cuts[k], k + 1  # the head alone: kept for the piece that follows
                continue
            if k >= i:
                take(cuts[k], LEVELS[level])
                at, i = cuts[k], k + 1
                continue
            last = i == j
            child = b if last else cuts[i]
            descend(at, child, level + 1, boundary if last else LEVELS[level])
            if last:
                return
            at, i = child, i + 1

    descend(0, text.n, 0, "end")
    return out


def analysed(contents: list[str], vocabulary: str) -> list[Text]:
    """The texts with their places; boundaries are found over all of them at once."""
    raws = [c.encode("utf-8", "surrogatepass") for c in contents]
    sizes = token_bytes(vocabulary)
    ends = [np.concatenate([[0], np.cumsum(sizes[np.array(encode(c, vocabulary), np.int64)])]) for c in contents]
    byte_at = np.cumsum([1, *(len(r) + 1 for r in raws)])
    place_at = np.cumsum([0, *map(len, ends)])
    joined = b"\n" + b"\n".join(raws) + b"\n"  # so that every text begins a line
    at_byte = np.concatenate(ends) + np.repeat(byte_at[:-1], np.diff(place_at))
    whole = (np.frombuffer(joined, np.uint8)[at_byte] & 0xC0) != 0x80
    levels = []
    for places in boundaries(joined, byte_at[:-1]):
        places = places[places < byte_at[-1]]
        at = np.searchsorted(at_byte, places, side="right") - 1  # a blank belongs to the token that begins with it
        at = at[whole[at]]
        at = at[np.concatenate([[True], at[1:] > at[:-1]])] if len(at) else at
        levels.append((at, np.searchsorted(at, place_at)))
    return [
        Text(raws[i], ends[i], whole[place_at[i] : place_at[i + 1]], [(at, cut, i, place_at[i]) for at, cut in levels], vocabulary)
        for i in range(len(raws))
    ]


def _split(limits: list[tuple[int, int, int]], vocabulary: str) -> object:
    least = min((m for _, m, _ in limits), default=0)

    def pieces_of(batch: pa.RecordBatch, origin: list[int], contents: list[str]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        source: list[int] = []
        for i, text in zip(origin, analysed(contents, vocabulary), strict=True):
            for limit_id, most, overlap in limits:
                if text.n <= most:
                    continue
                last = 0
                for no, (begin, end, boundary) in enumerate(pack(text, most, overlap), 1):
                    rows.append((limit_id, no, end - begin, max(0, last - begin), boundary, text.slice(begin, end)))
                    source.append(i)
                    last = end
        if rows:
            yield _batch(batch, source, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            origin, contents, held = [], [], 0
            for i, content in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                # a token has one byte at least, a code point four at most
                if content is None or (len(content) * 4 <= least or len(content.encode("utf-8", "surrogatepass")) <= least):
                    continue
                origin.append(i)
                contents.append(content)
                held += len(content)
                if held > TOGETHER:
                    yield from pieces_of(batch, origin, contents)
                    origin, contents, held = [], [], 0
            if contents:
                yield from pieces_of(batch, origin, contents)

    return run


def _batch(batch: pa.RecordBatch, origin: list[int], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
    made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    key = batch.column(0).take(pa.array(origin, pa.int64()))
    return pa.RecordBatch.from_arrays([key, *made], [batch.schema.field(0).name, "limit_id", "piece_no", "n_tokens", "overlap_tokens", "boundary", "piece"])


def pieces(documents: DataFrame, limits: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, limit_id, piece_no, n_tokens, overlap_tokens, boundary, piece) for every text longer than max_tokens.

    n_tokens and overlap_tokens count the text's own tokens; a piece encoded by itself has at most max_tokens as
    well. Pieces are numbered from 1; joined without their overlaps they give the text back. Null and short
    texts give no pieces. The overlap is exact unless that would split a character (then a little more) or the
    limit leaves no room (an overlap over half the limit is refused). No shuffle.
    """
    rows = [(int(r["limit_id"]), int(r["max_tokens"]), int(r["overlap_tokens"] or 0)) for r in limits.where("limit_id is not null and max_tokens is not null").distinct().collect()]
    for _, most, overlap in rows:
        if most < 8 or overlap < 0 or overlap * 2 > most:
            raise ValueError("a limit needs at least 8 tokens and an overlap of at most half of them")
    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key), F.col(text).alias("_text")).mapInArrow(_split(sorted(rows), vocabulary), f"`{key}` {kind}, {PIECE}")
