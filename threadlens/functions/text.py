"""Text columns: whitespace, markup, caps, tokens, folding."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

# Fixed values -----------------------------------------------------------
TEXT_CAP = 5000
WHITESPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
MARKUP = r"<[^>]+>"
TOKEN_BREAK = r"[^\p{L}\p{N}\p{Co}]+"
#: The same for text that is ASCII and lower case.
ASCII_BREAK = "[^a-z0-9]+"
COMBINING = "".join(map(chr, range(0x0300, 0x0332)))
# ------------------------------------------------------------------------


def _latin_folds() -> tuple[str, str]:
    """Lower-case letters that are an ASCII letter plus exactly one mark."""
    marked, plain = [], []
    for cp in [*range(0x00DF, 0x0250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(cp))
        if len(parts) == 2 and parts[0].isascii() and parts[0].islower():
            marked.append(chr(cp))
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _latin_folds()


def strip_ws(col: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.regexp_replace(col, f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def squeeze_ws(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, f"{WHITESPACE}+", " "))


def strip_html(col: Column) -> Column:
    """Markup to blanks, runs of whitespace to one blank, trimmed."""
    return squeeze_ws(F.regexp_replace(col, MARKUP, " "))


def cap(col: Column, limit: int = TEXT_CAP) -> Column:
    """struct(text, chars, truncated): text cut to ``limit`` code points."""
    chars = F.length(col)
    return F.struct(
        F.substring(col, 1, limit).alias("text"),
        chars.cast("long").alias("chars"),
        (chars > limit).alias("truncated"),
    )


def fold(col: Column) -> Column:
    """Lower case without Latin diacritics, as the index compares words."""
    # translate drops the characters that have no counterpart: combining marks
    return F.translate(F.lower(F.replace(col, F.lit("İ"), F.lit("I"))), _MARKED + COMBINING, _PLAIN)


def tokens(col: Column) -> Column:
    """Folded runs of letters and digits, in order."""
    # ASCII texts have nothing to fold but case; translate costs more than the split itself.
    ascii_only = F.length(col) == F.octet_length(col)
    return F.array_remove(
        F.when(ascii_only, F.split(F.lower(col), ASCII_BREAK)).otherwise(F.split(fold(col), TOKEN_BREAK)), "")


def words(col: Column) -> Column:
    """Whitespace-separated words of a typed query."""
    return F.array_remove(F.split(col, f"{WHITESPACE}+"), "")


def fold_subject(col: Column) -> Column:
    """Subject with case, quotes, dashes and whitespace evened out."""
    return squeeze_ws(F.translate(F.lower(col), "‘’‛“”–—", "'''\"\"--"))


def ascii_lower(col: Column) -> Column:
    """Fold A-Z only."""
    # translate makes a string of every character; ASCII texts have no other letters to keep.
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(
        F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def date_label(first: Column, last: Column) -> Column:
    """``first — last`` when the days differ, else the last day."""
    a, b = F.substring(first, 1, 10), F.substring(last, 1, 10)
    return F.when((first != "") & (a != b), F.concat(a, F.lit(" — "), b)).otherwise(b)


def citations(col: Column) -> Column:
    """Subjects named on lines of their own after ``THREAD: ``."""
    return F.transform(F.regexp_extract_all(col, F.lit("(?m)^THREAD: (.+)$"), F.lit(1)), strip_ws)


def message_text(col: Column, limit: int = TEXT_CAP) -> Column:
    """A message body without markup, capped."""
    return cap(strip_html(F.coalesce(col, F.lit(""))), limit)
