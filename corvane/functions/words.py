"""Column expressions on words: the longest runs of Unicode letters and digits of the lower-cased text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode and the four ASCII separators, as stripped at both ends of a name.
BLANKS = r"[\s\p{Z}\x1c-\x1f\x85]+"


def words(text: Column) -> Column:
    """All words in order; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def word_hashes(text: Column) -> Column:
    """All words in order as 64-bit hashes."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def strip(text: Column) -> Column:
    """Without outer blanks."""
    return F.regexp_replace(text, f"^{BLANKS}|{BLANKS}$", "")


def level_name(name: Column) -> Column:
    """A database name in its level spelling: lower case, no outer blanks, hyphen and blank as underscore."""
    return F.translate(F.lower(strip(name)), "- ", "__")
