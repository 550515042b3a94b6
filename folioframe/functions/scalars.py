"""Scalar functions as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"


def stable_id(path: Column, structural_path: Column) -> Column:
    """``h:`` and 14 hexadecimal digits of the SHA-1 of ``path:structural_path``."""
    return F.concat(F.lit("h:"), F.substring(F.sha1(F.concat_ws(":", path, structural_path).cast("binary")), 1, 14))


def iso_calendar_valid(s: Column) -> Column:
    """The string itself where it is a canonical UTC time of a real day, else NULL."""
    real = F.try_to_timestamp(F.regexp_replace(s, "[TZ]", " "), F.lit("yyyy-MM-dd HH:mm:ss ")).isNotNull()
    return F.when(s.rlike(ISO_SHAPE) & real, s)


def estimate_tokens(text: Column) -> Column:
    """Heuristic token count: code points over 2.7 (fenced), 1.5 (CJK) or 3.5."""
    n = F.char_length(text)
    fenced = n - F.char_length(F.regexp_replace(text, r"(?s)```.*?(```|$)", ""))
    cjk = n - F.char_length(F.regexp_replace(text, r"[぀-ヿ㐀-䶿一-鿿가-힯]", ""))
    per = F.when(fenced > n * 0.3, 2.7).when(cjk > n * 0.3, 1.5).otherwise(3.5)
    blank = ~text.rlike(r"[^\x00-\x20]")
    return F.when(blank, 0).otherwise(F.greatest(F.lit(1), F.floor(n / per + 0.5))).cast("long")


def ms_to_iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(F.floor(ms)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def heading_text(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"\s+", " ")


def slug(text: Column) -> Column:
    """Lower case, only letters, digits, spaces, ``_`` and ``-``; white space becomes ``-``."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}\s_-]", ""), r"\s", "-")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(?<=.)\.([^.]*)$", 1))



def path_policy(path: Column) -> Column:
    """The first rule that a vault path breaks, or NULL."""
    parts = F.split(path, "/")
    return (
        F.when(F.trim(path) == "", "EMPTY")
        .when(F.char_length(path) > 1024, "TOO_LONG")
        .when(path.contains("\x00"), "NUL_BYTE")
        .when(path.rlike(r"[\x01-\x1F\x7F]"), "CONTROL_CHAR")
        .when(path.rlike("%[0-9A-Fa-f]{2}"), "PERCENT_ENCODED")
        .when(path.contains("\\"), "BACKSLASH")
        .when(path.startswith("/"), "ABSOLUTE")
        .when(F.array_contains(parts, ".") | F.array_contains(parts, ".."), "DOT_SEGMENT")
        .when(F.size(parts) > 32, "TOO_DEEP")
    )
