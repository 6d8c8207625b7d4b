"""Text expressions: words, lexemes, content, excerpts, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import values as V

WORD = r"([\p{L}\p{N}]+)"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))


def query_lexemes(question: Column) -> Column:
    """Distinct non-stop words of a question, in order of first appearance."""
    return F.array_distinct(F.filter(words(question), lambda w: ~w.isin(V.STOP_WORDS)))


def content(summary: Column, description: Column, strategy: str) -> Column:
    """Text to embed.  Only a NULL description is left out; an empty one still adds the separator."""
    head = F.coalesce(summary, F.lit(""))
    if strategy == "summary_only":
        return head
    if strategy == "summary_desc":
        return F.when(description.isNull(), head).otherwise(F.concat(head, F.lit("\n\n"), description))
    raise ValueError(f"unknown strategy {strategy!r}")


def clip(text: Column, chars: int | None) -> Column:
    """First ``chars`` code points, or the whole text."""
    return text if chars is None else F.substring(text, 1, chars)


def rerank_text(summary: Column, description: Column, chars: int | None = None) -> Column:
    """Document side of a (question, document) pair.  A missing issue gives an empty text."""
    body = F.concat(F.coalesce(summary, F.lit("")), F.lit("\n"),
                    clip(F.coalesce(description, F.lit("")), chars))
    return body


def overlap_score(question: Column, document: Column) -> Column:
    """Share of the question's distinct words that the document holds (default pair scorer)."""
    asked = F.array_distinct(words(question))
    return F.coalesce(
        F.try_divide(F.size(F.array_intersect(asked, words(document))).cast("double"),
                     F.size(asked).cast("double")),
        F.lit(0.0))


def citation_pattern(project: str = "SPARK") -> str:
    """Key pattern of one project, e.g. ``SPARK-123``."""
    return rf"({project}-[0-9]+)"


def cited_keys(answer: Column, project: str = "SPARK") -> Column:
    """Unique cited keys in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(citation_pattern(project)), F.lit(1)))


def excerpt(text: Column, key: Column) -> Column:
    """Characters around the first place ``key`` appears."""
    start = F.instr(text, key)
    first = F.greatest(start - V.EXCERPT_BEFORE, F.lit(1))
    return F.substring(text, first, start + V.EXCERPT_AFTER - first)


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_fence(response: Column) -> Column:
    """Drop a leading code fence line and the closing fence of a model response."""
    body = strip_space(response)
    opened = F.regexp_replace(body, r"^```(?:[^\n]*\n)?", "")
    unfenced = strip_space(F.regexp_replace(opened, r"\s*```\s*$", ""))
    return F.when(body.startswith("```"), unfenced).otherwise(body)


def is_day(text: Column) -> Column:
    return text.rlike(r"^\d{4}-\d{2}-\d{2}$")


def bound_time(text: Column) -> Column:
    """Time of a filter bound: a whole day or a full timestamp that exists in the calendar, else NULL ("2020", "2020-02-30")."""
    full = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?$")
    return F.when(is_day(text) | full, F.try_to_timestamp(text))


def named_in(question: Column, name: Column) -> Column:
    """True if ``name`` stands in the question as a whole word, singular or plural.

    A "sub-task" mention does not count as "task".
    """
    base = F.lower(name)
    singular = F.regexp_replace(base, "s$", "")
    lowered = F.lower(question)
    without_sub = F.replace(F.replace(lowered, F.lit("sub-task"), F.lit("")), F.lit("subtask"), F.lit(""))
    pattern = F.concat(F.lit(r"(?U)\b\Q"), singular, F.lit(r"\Es?\b"))
    return F.when(base == "task", F.rlike(without_sub, pattern)).otherwise(F.rlike(lowered, pattern))


def kept_of_total(text: Column) -> tuple[Column, Column]:
    """Parse "x/y" into two integers; malformed text gives NULLs."""
    parts = F.split(text, "/")
    pair = F.size(parts) == 2
    return F.when(pair, parts[0].try_cast("int")), F.when(pair, parts[1].try_cast("int"))


def embed_query_text(question: Column) -> Column:
    """Question text with the retrieval instruction in front."""
    return F.concat(F.lit(V.QUERY_PREFIX), question)
