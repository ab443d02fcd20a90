"""Text scalars: prefixes, versions, file names, structured names, signatures, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefix_or_whole(c: Column, sep: str = "_") -> Column:
    """Text before the first separator; the whole text where there is none."""
    return F.substring_index(c, sep, 1)


def prefix_or_empty(c: Column, sep: str = "_") -> Column:
    """Text before the first separator; '' where there is none."""
    return F.when(F.instr(c, sep) > 0, F.substring_index(c, sep, 1)).otherwise(F.when(c.isNotNull(), ""))


def prefix_or(c: Column, fallback: Column, sep: str = "_") -> Column:
    """Upper-case text before the first separator; the fallback where there is none or it is empty."""
    head = F.when(F.instr(c, sep) > 1, F.upper(F.substring_index(c, sep, 1)))
    return F.coalesce(head, fallback)


def patch_of(version: Column) -> Column:
    """First two dot-separated parts; the whole text if there are fewer."""
    parts = F.split(version, r"\.")
    return F.when(F.size(parts) >= 2, F.concat_ws(".", parts[0], parts[1])).otherwise(version)


def id_of_file(name: Column) -> Column:
    """File name without .json or .json.zst."""
    return F.regexp_replace(name, r"\.json(\.zst)?$", "")


def without_hash_suffix(c: Column) -> Column:
    return F.regexp_replace(c, "_[0-9a-f]{8}$", "")


def extract_or(c: Column, pattern: str, default: str, group: int = 1) -> Column:
    """A group of the first match of pattern; default where nothing or an empty text matches."""
    return F.coalesce(F.nullif(F.regexp_extract(c, pattern, group), F.lit("")), F.lit(default))


def by_rules(c: Column, rules: list[tuple[str, str]], kind: str = "prefix", default: str | None = None) -> Column:
    """Value of the first rule whose needle starts (prefix) or occurs in (contains) the text, in rule order."""
    test = c.startswith if kind == "prefix" else c.contains
    chain = reduce(lambda acc, r: acc.when(test(r[0]), r[1]), rules[1:], F.when(test(rules[0][0]), rules[0][1]))
    return chain.otherwise(F.lit(default))


# Crawler prefixes in the order in which they are tried.
REGION_RULES = [("eune", "eune"), ("euw", "euw"), ("na", "na"), ("br", "br"), ("lan", "lan"), ("las", "las"), ("kr", "kr"), ("jp", "jp"), ("tw", "tw"), ("sg", "sg"), ("oce", "oce"), ("tr", "tr"), ("vn", "vn"), ("ru", "ru"), ("me", "me")]


def stack_name(c: Column) -> Column:
    """struct(region, vm, instance, crawler, keyns, snapshot_utc) of a folder name; null for other names.

    Three forms: six or three parts joined by '__', and <crawler>_prod_<8 hex digits> in any case.
    """
    parts = F.split(c, "__")
    names = ["region", "vm", "instance", "crawler", "keyns", "snapshot_utc"]
    none = F.lit(None).cast("string")

    def build(values: list[Column]) -> Column:
        return F.struct(*[v.cast("string").alias(n) for v, n in zip(values, names)])

    crawler = F.lower(F.regexp_extract(c, "(?i)^(.+)_prod_[0-9a-f]{8}$", 1))
    return (
        F.when(F.size(parts) == 6, build([F.get(parts, F.lit(i)) for i in range(6)]))
        .when(F.size(parts) == 3, build([by_rules(F.lower(parts[0]), REGION_RULES), none, none, parts[0], F.get(parts, F.lit(2)), none]))
        .when(c.rlike("(?i)^.+_prod_[0-9a-f]{8}$"), build([by_rules(crawler, REGION_RULES), none, none, crawler, none, none]))
    )


def recency(c: Column) -> Column:
    """Number after the last '_', -1 where there is none."""
    return F.coalesce(F.substring_index(c, "_", -1).try_cast("bigint"), F.lit(-1).cast("bigint"))


def label(head: Column, number: Column, letter: str = "h", width: int = 2) -> Column:
    """'head_h07': a composite label with a zero-padded number."""
    return F.concat(head, F.lit(f"_{letter}"), F.lpad(number.cast("string"), width, "0"))


def signature(columns: list[str], bits: int = 256) -> Column:
    """Hash of the canonical JSON of the columns in name order; nulls are kept."""
    text = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    return F.sha1(text) if bits == 160 else F.sha2(text, bits)


# Classes of feature names by suffix, in the order in which they are tried.
NAME_CLASSES = [("_pm_avg", "per_minute_avg"), ("_pm_delta", "per_minute_delta"), ("_share_avg", "share_avg"), ("_delta", "delta"), ("_avg", "avg")]


def name_class(c: Column, classes: list[tuple[str, str]] | None = None, default: str = "other") -> Column:
    classes = classes or NAME_CLASSES
    chain = reduce(lambda acc, r: acc.when(c.endswith(r[0]), r[1]), classes[1:], F.when(c.endswith(classes[0][0]), classes[0][1]))
    return chain.otherwise(default)


def fixed(c: Column, digits: int = 6, percent: bool = False) -> Column:
    """A number with a fixed count of decimals; '' for null, NaN and infinities."""
    v = c.cast("double") * (100 if percent else 1)
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(bad, "").otherwise(F.format_string(f"%.{digits}f" + ("%%" if percent else ""), v))


def rate_pairs(c: Column) -> Column:
    """map<window seconds, limit> of a header 'limit:seconds,limit:seconds'; malformed parts are left out."""
    parts = F.filter(F.split(c, ","), lambda x: x.rlike(r"^\s*\d+\s*:\s*\d+\s*$"))
    number = lambda x, i: F.trim(F.get(F.split(x, ":"), F.lit(i))).cast("bigint")
    return F.map_from_entries(F.array_distinct(F.transform(parts, lambda x: F.struct(number(x, 1), number(x, 0)))))


def rate_usage(limits: Column, counts: Column) -> Column:
    """map<window seconds, count / limit> for windows that both headers have."""
    return F.map_filter(F.map_zip_with(rate_pairs(limits), rate_pairs(counts), lambda _, a, b: F.try_divide(b, a)), lambda _, v: v.isNotNull())


def retry_after(c: Column, now: Column) -> Column:
    """Seconds to wait of a Retry-After header: a number of seconds, or an HTTP date seen from now (epoch seconds)."""
    seconds = c.try_cast("double")
    date = F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(F.substring_index(c, ", ", -1), " GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss")))
    return F.greatest(F.lit(0.0), F.coalesce(seconds, (date - now).cast("double")))
