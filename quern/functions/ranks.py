"""Ladder ranks: spelling, order, percentile and probit of rank and league points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Tiers and divisions from low to high.
TIERS = ("Iron", "Bronze", "Silver", "Gold", "Platinum", "Emerald", "Diamond")
DIVISIONS = ("IV", "III", "II", "I")
APEX = ("Master", "GrandMaster", "Challenger")
RANKS = tuple(f"{t} {d}" for t in TIERS for d in DIVISIONS) + APEX
# Shares of the default ladder in percent, in the order of RANKS, before normalising.
DEFAULT_SHARES = (
    0.074, 0.14, 0.45, 1.3, 4.9, 4.2, 4.5, 4.5, 7.3, 6.3, 6.2, 5.0, 8.5, 6.3, 5.6, 4.1, 6.7, 4.4, 3.5, 2.4, 3.9, 2.2, 1.7, 1.1,
    1.7, 0.81, 0.55, 0.44, 0.96, 0.094, 0.044,
)
# League points at which the default ladder's upper ranks begin.
GRANDMASTER_LP, CHALLENGER_LP, FIRST_LP = 1000.0, 1250.0, 2400.0
EPSILON_PCT = 0.01
# Points at which GrandMaster and Challenger begin and the first place stands, by server.
SERVER_CUTOFFS = {
    "BR1": (685.0, 1033.4, 2014.4),
    "EUN1": (664.0, 948.0, 2200.2),
    "EUW1": (1029.0, 1366.0, 2303.0),
    "JP1": (705.5, 1007.4, 1581.7),
    "KR": (1030.0, 1291.0, 2006.0),
    "LA1": (598.2, 943.0, 2300.6),
    "LA2": (577.4, 907.4, 1849.5),
    "NA1": (626.0, 969.6, 2351.0),
    "OC1": (478.0, 808.0, 1851.7),
    "SG2": (227.0, 575.0, 1721.9),
    "ME1": (478.0, 808.0, 1851.7),
    "TR1": (478.0, 808.0, 1851.7),
    "TW2": (245.0, 643.0, 1600.3),
    "VN2": (702.0, 1026.0, 2085.0),
}


def rank_name(tier: Column, division: Column) -> Column:
    """'Gold IV', 'GrandMaster', ...; null for unknown tiers and for division tiers without a valid division."""
    t, d = F.upper(F.trim(tier)), F.upper(F.trim(division))
    apex = F.create_map(*[F.lit(x) for a in APEX for x in (a.upper(), a)])
    plain = F.when(t.isin(*[x.upper() for x in TIERS]) & d.isin(*DIVISIONS), F.concat_ws(" ", F.initcap(F.lower(t)), d))
    return F.coalesce(apex[t], plain)


def rank_bucket(explicit: Column, tier: Column, division: Column) -> Column:
    """A bucket: the explicit one, else an apex tier, else TIER_DIV, else the tier; 'UNKNOWN' if there is none."""
    t, d = F.nullif(F.upper(F.trim(tier)), F.lit("")), F.nullif(F.upper(F.trim(division)), F.lit(""))
    return F.coalesce(
        F.nullif(F.upper(F.trim(explicit)), F.lit("")),
        F.when(t.isin(*[a.upper() for a in APEX]), t),
        F.when(t.isNotNull() & d.isNotNull(), F.concat_ws("_", t, d)),
        t,
        F.lit("UNKNOWN"),
    )


def bucket_order(bucket: Column) -> Column:
    """struct(tier, division, name) to sort buckets by; 998 for unknown tiers, 999 for UNKNOWN."""
    tiers = [t.upper() for t in TIERS + APEX]
    tier = F.substring_index(bucket, "_", 1)
    tmap = F.create_map(*[F.lit(x) for i, t in enumerate(tiers) for x in (t, i)])
    dmap = F.create_map(*[F.lit(x) for i, d in enumerate(DIVISIONS) for x in (d, i)])
    place = F.when(bucket == "UNKNOWN", 999).otherwise(F.coalesce(tmap[tier], F.lit(998)))
    return F.struct(place.alias("tier"), F.coalesce(dmap[F.substring_index(bucket, "_", -1)], F.lit(0)).alias("division"), bucket.alias("name"))


def ladder(spark: SparkSession, shares: dict[str, tuple[float, ...]] | None = None) -> DataFrame:
    """server, ord, rank, lower_pct, upper_pct: cumulative bounds, normalised to 100; server 'default' always."""
    rows = [(s, i, RANKS[i], float(p)) for s, ps in {"default": DEFAULT_SHARES, **(shares or {})}.items() for i, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "server string, ord int, rank string, share double")
    own, run = Window.partitionBy("server"), Window.partitionBy("server").orderBy("ord")
    upper = F.sum("share").over(run) / F.sum("share").over(own) * 100
    df = df.withColumn("upper_pct", upper).withColumn("lower_pct", F.lag("upper_pct", 1, 0.0).over(run))
    return df.select("server", "ord", "rank", "lower_pct", "upper_pct")


def cutoffs(spark: SparkSession, own: dict[str, tuple[float, float, float]] | None = None) -> DataFrame:
    """server, gm, chall, first: the points at which the upper ranks begin, of every server that has its own."""
    return spark.createDataFrame([(s, *c) for s, c in (own or SERVER_CUTOFFS).items()], "server string, gm double, chall double, first double")


def shares_of(spark: SparkSession, path: str) -> dict[str, tuple[float, ...]]:
    """Ladder shares by server from a table (server, ord, share) of 31 rows a server, for `ladder`; csv with a header.

    Raises ValueError where a server's ladder is not whole. A few rows for each server: read to the driver.
    """
    out: dict[str, dict[int, float]] = {}
    for r in spark.read.option("header", "true").schema("server string, ord int, share double").csv(path).collect():
        out.setdefault(r["server"].upper(), {})[r["ord"]] = r["share"]
    for server, shares in out.items():
        if sorted(shares) != list(range(len(RANKS))) or None in shares.values():
            raise ValueError(f"{path} has no whole ladder for {server}")
    return {s: tuple(v[i] for i in range(len(RANKS))) for s, v in out.items()}


def effective_rank(rank: Column, lp: Column, grandmaster: Column | float = GRANDMASTER_LP, challenger: Column | float = CHALLENGER_LP) -> Column:
    """The rank after at most one promotion: Master with enough points counts as GrandMaster, GrandMaster as Challenger."""
    return F.when((rank == "Master") & (lp >= grandmaster), "GrandMaster").when((rank == "GrandMaster") & (lp >= challenger), "Challenger").otherwise(rank)


def lp_fraction(rank: Column, lp: Column, grandmaster=GRANDMASTER_LP, challenger=CHALLENGER_LP, first=FIRST_LP) -> Column:
    """Place within an (effective) rank, in [0, 1]: of 100 points below Master, between the cut-offs above."""

    def part(low, high) -> Column:
        low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
        return F.least(F.greatest((lp - low) / F.greatest(high - low, F.lit(1e-9)), F.lit(0.0)), F.lit(1.0))

    return F.when(rank == "Master", part(0, grandmaster)).when(rank == "GrandMaster", part(grandmaster, challenger)).when(rank == "Challenger", part(challenger, first)).otherwise(part(0, 100))


def percentile_of(lower: Column, upper: Column, fraction: Column, epsilon: float = EPSILON_PCT) -> Column:
    return F.least(F.greatest(lower + fraction * (upper - lower), F.lit(epsilon)), F.lit(100 - epsilon))


# Coefficients of algorithm AS 241 (PPND16) for the normal quantile.
_A = (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727)
_B = (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610)
_C = (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4)
_D = (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9)
_E = (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7)
_F = (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)


def _ratio(x: Column, top: tuple, bottom: tuple) -> Column:
    def poly(coefficients: tuple) -> Column:
        out = F.lit(coefficients[-1])
        for c in coefficients[-2::-1]:
            out = out * x + c
        return out

    return poly(top) / poly(bottom)


def normal_quantile(p: Column) -> Column:
    """Quantile of the standard normal distribution, in plain expressions; null outside (0, 1)."""
    q = p - 0.5
    tail = F.sqrt(-F.log(F.least(p, 1 - p)))
    middle = q * _ratio(F.lit(0.180625) - q * q, _A, _B)
    side = F.when(tail <= 5, _ratio(tail - 1.6, _C, _D)).otherwise(_ratio(tail - 5.0, _E, _F))
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, middle).otherwise(F.signum(q) * side))


def normal_density(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def normal_cdf(x: Column) -> Column:
    """Distribution function: a series in the middle, a continued fraction in the tails; error below 1e-12.

    The argument is bound once, as the variable of an array transform, since it occurs in every term.
    """

    def of(v: Column) -> Column:
        a = F.abs(v)
        series, fraction = F.lit(1.0), a
        for k in range(60, 0, -1):
            series = 1 + series * (a * a / (2 * k + 1))
        for k in range(40, 0, -1):
            fraction = a + k / fraction
        upper = F.when(a < 3.0, 0.5 + normal_density(a) * a * series).otherwise(1 - normal_density(a) / F.greatest(fraction, F.lit(1e-300)))
        return F.when(v >= 0, upper).otherwise(1 - upper)

    return F.get(F.transform(F.array(x), of), F.lit(0))


def truncated_mean(lower: Column, upper: Column) -> Column:
    """Mean of a standard normal between the quantiles of two percentages; null if there is no mass between."""
    a, b = normal_quantile(lower / 100), normal_quantile(upper / 100)
    left = F.when(lower <= 0, 0.0).otherwise(normal_density(a))
    right = F.when(upper >= 100 - 1e-7, 0.0).otherwise(normal_density(b))
    return F.when(upper > lower, (left - right) / ((upper - lower) / 100))
