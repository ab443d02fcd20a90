"""Date and clock scalars: local time features, clock windows, durations."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import by_rules

# Zones by exact server.
SERVER_ZONES = {
    "BR1": "America/Sao_Paulo", "EUN1": "Europe/Warsaw", "EUW1": "Europe/Amsterdam", "JP1": "Asia/Tokyo", "KR": "Asia/Seoul",
    "LA1": "America/Mexico_City", "LA2": "America/Santiago", "ME1": "Asia/Dubai", "NA1": "America/Chicago", "OC1": "Australia/Sydney",
    "PBE1": "America/Los_Angeles", "PH2": "Asia/Manila", "RU": "Europe/Moscow", "SG2": "Asia/Singapore", "TH2": "Asia/Bangkok",
    "TR1": "Europe/Istanbul", "TW2": "Asia/Taipei", "VN2": "Asia/Ho_Chi_Minh",
}
# Zones by a part of the folder name, in the order in which they are tried.
FOLDER_ZONES = [
    ("euw", "Europe/Amsterdam"), ("eune", "Europe/Warsaw"), ("na", "America/Chicago"), ("br", "America/Sao_Paulo"), ("lan", "America/Mexico_City"),
    ("las", "America/Santiago"), ("kr", "Asia/Seoul"), ("jp", "Asia/Tokyo"), ("tw", "Asia/Taipei"), ("sg", "Asia/Singapore"), ("ph", "Asia/Manila"),
    ("th", "Asia/Bangkok"), ("vn", "Asia/Ho_Chi_Minh"), ("oce", "Australia/Sydney"), ("oc", "Australia/Sydney"), ("tr", "Europe/Istanbul"),
    ("ru", "Europe/Moscow"), ("me", "Asia/Dubai"), ("pbe", "America/Los_Angeles"),
]
# Half-open clock windows in local hours.
NIGHT, UNDERPERFORMING = (1.0, 7.0), (2.0, 8.5)


def zone_of(server: Column, folder: Column) -> tuple[Column, Column]:
    """(zone, 1 if a fallback was used): exact server, then folder rules, then the longest server family, then UTC."""
    exact = F.create_map(*[F.lit(x) for kv in SERVER_ZONES.items() for x in kv])[F.upper(server)]
    families = sorted(((k.rstrip("0123456789"), v) for k, v in SERVER_ZONES.items()), key=lambda x: -len(x[0]))
    family = by_rules(F.upper(F.coalesce(server, F.lit(""))), families)
    by_folder = by_rules(F.lower(F.coalesce(folder, F.lit(""))), FOLDER_ZONES, "contains")
    return F.coalesce(exact, by_folder, family, F.lit("UTC")), F.when(exact.isNotNull(), 0).otherwise(1)


def day_seconds(local: Column) -> Column:
    return F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)


def day_angle(local: Column) -> tuple[Column, Column]:
    """(sin, cos) of the time of day, without fractions of a second."""
    angle = day_seconds(local) * (2 * math.pi / 86400)
    return F.sin(angle), F.cos(angle)


def local_time(ms: Column, zone: Column) -> Column:
    """Local wall-clock timestamp of epoch milliseconds in a zone that may differ by row."""
    return F.from_utc_timestamp(F.timestamp_millis(ms), zone)


def local_time_columns(ms: Column, server: Column, folder: Column) -> dict[str, Column]:
    """is_weekend, local_time_sin, local_time_cos, server_timezone_fallback_used; fixed values for times <= 0 or null."""
    zone, fallback = zone_of(server, folder)
    local = local_time(ms, zone)
    sin, cos = day_angle(local)
    known = F.coalesce(ms > 0, F.lit(False))
    return {
        "is_weekend": F.when(known, (F.weekday(local) >= 5).cast("int")).otherwise(0),
        "local_time_sin": F.when(known, sin).otherwise(0.0),
        "local_time_cos": F.when(known, cos).otherwise(1.0),
        "server_timezone_fallback_used": F.when(known, fallback).otherwise(1),
    }


def clock_hour(local: Column) -> Column:
    """Hour of the day with fractions down to microseconds."""
    return F.hour(local) + F.minute(local) / 60 + F.date_part(F.lit("SECONDS"), local).cast("double") / 3600


def in_clock_window(hour: Column, start: float, end: float) -> Column:
    """start <= hour < end; a window with start >= end wraps around midnight."""
    return ((hour >= start) & (hour < end)) if start < end else ((hour >= start) | (hour < end))


def duration_s(duration: Column, start_ms: Column, end_ms: Column) -> Column:
    """Seconds: the duration if positive, else end - start if end > start > 0, else 0."""
    d = F.coalesce(duration.cast("double"), F.lit(0.0))
    return F.when(d > 0, d).when((end_ms > start_ms) & (start_ms > 0), (end_ms - start_ms) / 1000.0).otherwise(0.0)


def eta(done: Column, total: Column, elapsed_s: Column) -> dict[str, Column]:
    rate = F.try_divide(done, elapsed_s)
    return {"rate": rate, "remaining_s": F.try_divide(total - done, rate), "s_per_1000": F.try_divide(F.lit(1000.0), rate)}
