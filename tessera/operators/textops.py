"""Text operators over documents: provenance, excerpts, term leaks and definitions. Offsets are bytes of UTF-8."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DEFINITION = 2000


def byte_start(text: Column, needle: Column) -> Column:
    """0-based byte offset of the first occurrence; null if there is none or the needle is empty."""
    at = F.instr(text, needle)
    return F.when((at > 0) & (F.length(needle) > 0), F.octet_length(F.substring(text, F.lit(1), at - 1)))


def locate(pages: DataFrame, needle: Column, id_column: str = "doc_id") -> DataFrame:
    """(id, page_idx, char_start, char_end) of the first page of each document that contains the needle."""
    start = byte_start(F.col("text"), needle)
    hits = pages.select(id_column, "page_idx", start.alias("char_start"), (start + F.octet_length(needle)).alias("char_end")).where("char_start is not null")
    return hits.groupBy(id_column).agg(F.min(F.struct("page_idx", "char_start", "char_end")).alias("m")).select(id_column, "m.*")


def excerpt(text: Column, start: Column, end: Column) -> Column:
    """The bytes [start, end); an invalid range gives the whole text, a range that splits a character a U+FFFD."""
    data = F.encode(text, "UTF-8")
    part = F.make_valid_utf8(F.substring(data, start + 1, end - start).cast("string"))
    return F.when((start >= 0) & (end > start) & (end <= F.octet_length(text)), part).otherwise(text)


def term_pattern(term: str) -> str:
    """Whole-word, case-insensitive; a boundary stands only at an edge that is a word character."""
    word = lambda c: c == "_" or c.isalnum()
    left, right = (r"(?<![\p{L}\p{N}_])" if word(term[0]) else ""), (r"(?![\p{L}\p{N}_])" if word(term[-1]) else "")
    return f"(?iu){left}{re.escape(term)}{right}"


def leaked_terms(text: Column, terms: list[str]) -> Column:
    """The terms that a text contains, in the given order."""
    return F.filter(F.array(*[F.when(text.rlike(term_pattern(t)), F.lit(t)) for t in terms if t]), lambda t: t.isNotNull())


def valid_definition(text: Column, most: int = MAX_DEFINITION) -> Column:
    return (F.length(F.trim(text)) > 0) & (F.octet_length(text) <= most) & ~text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")


def bracketed_terms(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\[([^\[\]]*)\]"), F.lit(1)), lambda t: F.trim(t)), lambda t: t != "")
