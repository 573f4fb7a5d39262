"""Text and SQL normalisation as column expressions. All stay in the JVM and keep null as null unless said otherwise."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prices, prompts and the like are left to the caller; these are the constants of the text rules.
PUNCTUATION = string.punctuation
CHARS_PER_TOKEN = 3.8

#: Reserved words that must be quoted as identifiers.
RESERVED_WORDS = tuple(
    """abort action add after all alter always analyze and as asc attach autoincrement before begin between by
    cascade case cast check collate column commit conflict constraint create cross current current_date
    current_time current_timestamp database default deferrable deferred delete desc detach distinct do drop each
    else end escape except exclude exclusive exists explain fail filter first following for foreign from full
    generated glob group having if ignore immediate in index indexed initially inner insert instead intersect
    into is isnull join key last left like limit match materialized natural no not nothing notnull null nulls of
    offset on or order others outer over partition plan pragma preceding primary query raise range recursive
    references regexp reindex release rename replace restrict returning right rollback row rows savepoint select
    set table temp temporary then ties to transaction trigger unbounded union unique update using vacuum values
    view virtual when where window with without""".split()
)

_SPACE = r"(?U)[\s\x1c-\x1f]+"


def trimmed(text: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def normalize_question(text: Column) -> Column:
    """Lower case, no ASCII punctuation, white space collapsed to single blanks."""
    return trimmed(F.regexp_replace(F.translate(F.lower(text), PUNCTUATION, ""), _SPACE, " "))


def normalize_sql(sql: Column) -> Column:
    """Comments to blanks, white space collapsed, final semicolons dropped, all in lower case (literals too)."""
    bare = F.regexp_replace(F.regexp_replace(sql, r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " ")
    flat = trimmed(F.regexp_replace(bare, _SPACE, " "))
    return F.lower(F.regexp_replace(flat, r"\s*;[;\s]*$", ""))


def tokens(text: Column) -> Column:
    """Non-empty parts between white space."""
    return F.filter(F.split(F.regexp_replace(text, _SPACE, " "), " "), lambda x: x != "")


def chars(text: Column) -> Column:
    """Single characters."""
    return F.filter(F.split(text, ""), lambda x: x != "")


def ngrams(parts: Column, n: int) -> Column:
    """The distinct n-grams of an array, joined by blanks; a shorter array is one gram, an empty one has none."""
    if n < 1:
        raise ValueError("n must be at least 1")
    # a one-element transform binds the array, so that the grams don't compute it anew one by one
    return F.get(F.transform(F.array(parts), lambda p: _ngrams_of(p, n)), F.lit(0))


def _ngrams_of(parts: Column, n: int) -> Column:
    last = F.size(parts) - (n - 1)
    full = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, n), " "))
    return F.when(F.size(parts) == 0, F.array().cast("array<string>")).when(last < 1, F.array(F.array_join(parts, " "))).otherwise(F.array_distinct(full))


def gram_hashes(parts: Column, n: int) -> Column:
    """``ngrams`` as 64-bit hashes, without making the grams' strings."""
    hashed = F.transform(parts, lambda w: F.xxhash64(w))
    last = lambda p: F.greatest(F.size(p) - (n - 1), F.lit(1))
    full = lambda p: F.array_distinct(F.transform(F.sequence(F.lit(1), last(p)), lambda i: F.xxhash64(F.slice(p, i, n))))
    return F.get(F.transform(F.array(hashed), lambda p: F.when(F.size(p) == 0, F.array().cast("array<bigint>")).otherwise(full(p))), F.lit(0))


def jaccard(a: Column, b: Column, n: int = 4, char_level: bool = False) -> Column:
    """n-gram Jaccard of two normalised texts: 1 if they are equal, 0 if one is empty."""
    cut = chars if char_level else tokens
    x, y = ngrams(cut(a), n), ngrams(cut(b), n)
    shared = F.size(F.array_intersect(x, y))
    ratio = shared / (F.size(x) + F.size(y) - shared)
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(ratio)


def search_terms(text: Column) -> Column:
    """Terms for ranking: of the lower-cased runs of letters, digits and underscores those that are ASCII."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\p{L}\p{N}_])[a-z0-9_]++(?![\p{L}\p{N}_])"), F.lit(0))


def token_estimate(text: Column) -> Column:
    """The larger of length / 3.8, rounded up, and the number of words; 0 for an empty or null text."""
    guess = F.greatest(F.ceil(F.length(text) / F.lit(CHARS_PER_TOKEN)).cast("bigint"), F.size(tokens(text)).cast("bigint"))
    return F.when(text.isNull() | (text == ""), F.lit(0).cast("bigint")).otherwise(guess)


def quote_identifier(name: Column) -> Column:
    """The name as it stands if it is plain and not reserved, else in double quotes."""
    bare = trimmed(name)
    plain = bare.rlike("^[a-zA-Z_][a-zA-Z0-9_]*$") & ~F.lower(bare).isin(*RESERVED_WORDS)
    return F.when(plain, bare).otherwise(F.concat(F.lit('"'), F.replace(bare, F.lit('"'), F.lit('""')), F.lit('"')))


def clean_model_sql(text: Column) -> Column:
    """The statement in a model's answer: the first fenced part that is tagged sql or begins a query, if any,
    with a final semicolon."""
    plain = trimmed(text)
    parts = F.transform(F.filter(F.split(plain, "```"), lambda p, i: (i % 2) == 1), trimmed)
    wanted = F.filter(parts, lambda p: p.rlike("(?i)^(sql|select|with)"))
    first = F.get(wanted, F.lit(0))
    body = F.coalesce(trimmed(F.regexp_replace(first, "(?i)^sql", "")), plain)
    return F.when(body.endswith(";"), body).otherwise(F.concat(body, F.lit(";")))


def same_statement(a: Column, b: Column) -> Column:
    """Equality of the texts but for outer blanks and final semicolons."""
    end = lambda c: F.regexp_replace(trimmed(c), ";+$", "")
    return F.coalesce(end(a) == end(b), F.lit(False))


def has_order_by(sql: Column) -> Column:
    """Whether ORDER BY stands anywhere in the text."""
    return F.coalesce(sql.rlike(r"(?i)\border\s+by\b"), F.lit(False))


def first_keyword(sql: Column) -> Column:
    """The first word in upper case; empty for a blank text."""
    return F.upper(F.coalesce(F.get(tokens(sql), F.lit(0)), F.lit("")))


def masked(secret: Column) -> Column:
    """First and last four characters; nothing of a secret of eight or fewer."""
    return F.when(F.length(secret) <= 8, F.lit("********")).otherwise(F.concat(F.left(secret, F.lit(4)), F.lit("..."), F.right(secret, F.lit(4))))
