"""Text columns: cleaning, documents, tokens, lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: what counts as emoji, junk and a phone number ------------------------------------------------
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{2B00}-\x{2BFF}]"
JUNK = r"(?U)https?://\S+|www\.\S+|\S+@\S+\.\w+|&[a-z]{2,6};"
PHONE = r"(?U)(?:\+7|8)[\s\-(]*\d{3}[\s\-)]*\d{3}[\s\-]*\d{2}[\s\-]*\d{2}"
QUERY_ID = r"^.{16}$"
ITEM_ID = r"^[0-9a-f]{16}$"
# ----------------------------------------------------------------------------------------------------------------
TOKEN = r"[\p{L}\p{N}_]+"


def clean_text(text: Column) -> Column:
    """Emoji, links, addresses, entities and phone numbers become spaces; spaces are collapsed and trimmed."""
    for pattern in (EMOJI, JUNK, PHONE, r"(?U)\s+"):
        text = F.regexp_replace(text, pattern, " ")
    return F.trim(text)


def doc_text(title: Column, description: Column) -> Column:
    """The document of an item: title, a space, description, cleaned; nulls are empty."""
    return clean_text(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit(""))))


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores in any script."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def word_count(text: Column) -> Column:
    """Runs without white space, Unicode spaces included."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+"), F.lit(0)))


def ngrams(words: Column, n: int) -> Column:
    """All n-grams of an array of words, joined with spaces."""
    at = F.sequence(F.lit(1), F.size(words) - (n - 1))
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def coverage(query: Column, *fields: Column) -> Column:
    """Share of the query's distinct words that any field holds; null for a query without words."""
    found = F.array_distinct(F.flatten(F.array(*fields)))
    wanted = F.array_distinct(query)
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, found)) / F.size(wanted))


def is_query_id(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(QUERY_ID)


def is_item_id(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(ITEM_ID)


def percent(x: Column, digits: int = 2) -> Column:
    """0.8775 as 87.75%."""
    return F.format_string(f"%.{digits}f%%", x * 100)


def points(x: Column, digits: int = 2) -> Column:
    """A difference in percentage points, with its sign."""
    return F.format_string(f"%+.{digits}f", x * 100)
