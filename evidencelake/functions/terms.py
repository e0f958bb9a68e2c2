"""Terms of texts, and the two word lists that retrieval and grounding leave out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content in questions.
QUERY_STOPWORDS = (
    "a", "an", "and", "are", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the",
    "this", "to", "was", "were", "what", "when", "where", "which", "who", "why", "how",
)
#: Words that carry no content in claims.
CLAIM_STOPWORDS = (
    "the", "a", "an", "is", "are", "was", "were", "of", "in", "on", "to", "and", "or", "for", "with", "that",
    "this", "it", "as", "by", "from", "be", "at", "which", "its", "these", "those", "has", "have", "had",
    "not", "but", "can", "could", "will", "would", "may", "might", "also", "than", "into", "such", "each",
    "more", "most", "some", "any",
)


def terms(text: Column, stopwords: tuple[str, ...]) -> Column:
    """Distinct lower-case runs of ASCII letters and digits without the stopwords."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1))
    return F.array_except(found, F.array(*map(F.lit, stopwords)))


def share(wanted: Column, there: Column) -> Column:
    """Share of wanted terms that are there; null where none is wanted."""
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, there)) / F.size(wanted))


def terms_sql(text: str, stopwords: tuple[str, ...]) -> str:
    """The DuckDB form of ``terms``."""
    return f"list_filter(list_distinct(regexp_extract_all(lower({text}), '[a-z0-9]+')), lambda w: NOT list_contains([{', '.join(repr(x) for x in stopwords)}], w))"
