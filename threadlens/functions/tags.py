"""Tag lists and tagger replies as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip_ws

# Fixed values -----------------------------------------------------------
MAX_TAGS = 60
EDIT_LIMIT = 20
EDIT_LENGTH = 60
# ------------------------------------------------------------------------


def clean_tags(col: Column, limit: int = MAX_TAGS) -> Column:
    """Trimmed, lower-cased, non-blank, distinct in first order, then capped."""
    tidy = F.filter(
        F.transform(col, lambda t: F.lower(strip_ws(t))), lambda t: t.isNotNull() & (t != "")
    )
    return F.slice(F.array_distinct(tidy), 1, limit)


def unfence(col: Column) -> Column:
    """Drop code fences around a reply."""
    return strip_ws(F.replace(F.replace(col, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))


def _tag_entry(tags: Column, truncated: Column) -> Column:
    return F.struct(tags.alias("tags"), truncated.alias("truncated"))


def salvage_tags(text: Column, expected: Column) -> Column:
    """Complete inner lists of a cut-off reply, padded or cut to ``expected``."""
    inner = F.transform(
        F.regexp_extract_all(text, F.lit(r"\[([^\[\]]*)\]"), F.lit(0)),
        lambda part: clean_tags(
            F.coalesce(F.from_json(part, "array<string>"), F.array().cast("array<string>"))
        ),
    )
    padding = F.array_repeat(F.array().cast("array<string>"), expected)
    return F.slice(F.concat(inner, padding), F.lit(1), expected)


def parse_tags(reply: Column, expected: Column) -> Column:
    """array<struct<tags, truncated>>, one entry per thread of the group."""
    text = unfence(F.coalesce(reply, F.lit("")))
    whole = F.from_json(text, "array<array<string>>")
    parsed = F.transform(whole, lambda t: _tag_entry(clean_tags(t), F.lit(False)))
    rescued = F.transform(
        salvage_tags(text, expected), lambda t: _tag_entry(t, F.size(t) == 0)
    )
    return F.when(whole.isNotNull() & (F.size(whole) == expected), parsed).otherwise(rescued)


def highlighted(tags: Column, query_words: Column) -> Column:
    """Tags that contain any of the lower-cased query words."""
    return F.filter(
        tags, lambda t: F.exists(query_words, lambda w: F.contains(t, F.lower(w)))
    )


def parse_reply(col: Column) -> Column:
    """Reply text to VARIANT: whole JSON, else the outermost braces, else prose."""
    return F.coalesce(
        F.try_parse_json(unfence(col)),
        F.try_parse_json(F.nullif(F.regexp_extract(col, r"\{[\s\S]*\}", 0), F.lit(""))),
        F.parse_json(F.to_json(F.struct(col.alias("conclusion"), F.lit("").alias("reasoning")))),
    )
