"""Identifiers: one spelling for the many in which the same match, bundle or player is written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH_FORM = r"^[A-Z][A-Z0-9]*_[0-9]{1,18}\z"
_MATCH_LOOSE = r"(?U)^\s*(?:.*[/\\])?\s*([A-Z][A-Z0-9]*)\s*[_-]\s*([0-9]{1,18})(?:\.[A-Z0-9.]*)?\s*\z"

# Spellings that stand for no player, after trimming, in upper case.
NO_PLAYER = ("BOT", "NULL", "NONE", "NAN", "N/A", "NA", "UNKNOWN", "UNDEFINED", "ANONYMOUS")
_NO_PLAYER_FILL = r"^[0_.?-]+\z"


def strip_space(c: Column) -> Column:
    """Without surrounding Unicode white space (no-break space included); null stays null."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def clean_match_id(c: Column) -> Column:
    """`SERVER_NUMBER` in upper case, without folders, file endings and white space; '-' counts as '_'.

    Text that is no match id at all is only trimmed; blank text and null give null.
    """
    up = F.upper(c)
    server, number = F.regexp_extract(up, _MATCH_LOOSE, 1), F.regexp_extract(up, _MATCH_LOOSE, 2)
    rest = F.nullif(strip_space(c), F.lit(""))
    return F.when(c.rlike(MATCH_FORM), c).when(server != "", F.concat(server, F.lit("_"), number)).otherwise(rest)


def clean_bundle(c: Column) -> Column:
    """Last path segment in lower case, without white space; blank and null give null."""
    plain = F.regexp_replace(strip_space(c), r"[/\\\s]+\z", "")
    name = F.lower(strip_space(F.regexp_replace(plain, r"^.*[/\\]", "")))
    return F.when(c.rlike(r"^[a-z0-9_]+\z"), c).otherwise(F.nullif(name, F.lit("")))


def clean_player(c: Column) -> Column:
    """The id without surrounding white space, case kept; null for values that stand for no player."""
    s = F.when(c.rlike(r"^[A-Za-z0-9_-]{40,}\z"), c).otherwise(strip_space(c))
    return F.when((s != "") & ~F.upper(s).isin(*NO_PLAYER) & ~s.rlike(_NO_PLAYER_FILL), s)


def key128(c: Column, prefix: str = "h") -> list[Column]:
    """Two independent 64-bit hashes: a 16-byte stand-in for a long key in shuffles."""
    return [F.xxhash64(c).alias(f"{prefix}1"), F.xxhash64(F.lit(7), c).alias(f"{prefix}2")]
