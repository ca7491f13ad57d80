"""Cleaning of intervals and instants, ordered rules, and the attrition they cause."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` if it has all ``names``; else ValueError with the missing ones."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def forbid_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` if it has none of ``names`` (columns that would leak the outcome); else ValueError."""
    if there := [n for n in names if n in df.columns]:
        raise ValueError(f"forbidden columns: {', '.join(there)}")
    return df


def hours_between(start: str, end: str) -> Column:
    return F.expr(f"timestampdiff(microsecond, {start}, {end})") / 3.6e9


def clean_intervals(df: DataFrame, least_h: float = 0.5, most_h: float = 8760.0, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Closed intervals with end >= start and a length in hours within [least_h, most_h]; inside the box (x0, y0, x1, y1)."""
    out = df.dropna(subset=["start_ts", "end_ts"]).where("end_ts >= start_ts").withColumn("duration_h", hours_between("start_ts", "end_ts")).where(F.col("duration_h").between(least_h, most_h))
    return out if box is None else in_bbox(out, box)


def in_bbox(df: DataFrame, box: tuple[float, float, float, float], x: str = "x_m", y: str = "y_m") -> DataFrame:
    """Rows inside the box, edges included."""
    return df.where(F.col(x).between(box[0], box[2]) & F.col(y).between(box[1], box[3]))


def dedup_by_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in the given total order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def map_category(df: DataFrame, code: str, mapping: dict[str, str], out: str = "category") -> DataFrame:
    """``out``: the label of ``code``; null if the code is not in ``mapping``."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return df.withColumn(out, F.create_map(*pairs)[F.col(code)])


def unmapped_codes(df: DataFrame, code: str, label: str, mapping: dict[str, str], keyword: str) -> DataFrame:
    """Codes outside ``mapping`` whose label matches the keyword pattern, with counts; must be empty for a clean run."""
    return df.where(F.col(label).rlike(keyword) & ~F.col(code).isin(list(mapping))).groupBy(code, label).agg(F.count("*").alias("n"))


def is_night(ts: str, start: int = 18, end: int = 6) -> Column:
    """Hour at or after ``start`` or at or before ``end``."""
    return (F.hour(ts) >= start) | (F.hour(ts) <= end)


def normalise_label(c: Column) -> Column:
    """Trimmed; empty or "unspecified" (any case) becomes null."""
    t = F.trim(c)
    return F.when((t != "") & (F.lower(t) != "unspecified"), t)


def standardise_label(c: Column, default: str = "UNKNOWN") -> Column:
    """Trimmed and upper-cased; missing becomes ``default``."""
    return F.coalesce(F.upper(normalise_label(c)), F.lit(default))


def classify_interval(least_h: float = 0.5) -> Column:
    """Exclusive class of an interval (start_ts, end_ts)."""
    return (
        F.when(F.col("start_ts").isNull(), "unparseable").when(F.col("end_ts").isNull(), "open").when(F.expr("end_ts < start_ts"), "reversed")
        .when(hours_between("start_ts", "end_ts") < least_h, "short").otherwise("closed")
    )


def cap_interval(df: DataFrame, snapshot: str, most_h: int) -> DataFrame:
    """``cap_ts``: the end or the snapshot, at most ``most_h`` hours after the start; ``capped`` says whether that bound bit."""
    end = F.coalesce("end_ts", F.expr(f"timestamp_ntz '{snapshot}'"))
    limit = F.expr(f"start_ts + interval {most_h} hours")
    return df.withColumn("cap_ts", F.least(end, limit)).withColumn("capped", end > limit)


def impute_interval(df: DataFrame, lag_h: int, imputed_h: int) -> DataFrame:
    """``dark_start``, ``dark_end``, ``how``: from ``lag_h`` before the start to a valid end, else to ``imputed_h`` after the start."""
    valid = F.expr("end_ts is not null and end_ts >= start_ts")
    return (
        df.withColumn("dark_start", F.expr(f"start_ts - interval {lag_h} hours"))
        .withColumn("dark_end", F.when(valid, F.col("end_ts")).otherwise(F.expr(f"start_ts + interval {imputed_h} hours")))
        .withColumn("how", F.when(valid, "closure").when(F.col("end_ts").isNull(), "imputed_open").otherwise("imputed_reversed"))
    )


def first_failing_rule(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``reason_code`` and ``reason_step`` (from 1) of the first rule a row breaks; null if it keeps all.

    A rule is (code, SQL condition to hold); a null condition counts as broken.
    """
    code, step = F.lit(None).cast("string"), F.lit(None).cast("int")
    for i, (name, holds) in reversed(list(enumerate(rules, 1))):
        broken = ~F.coalesce(F.expr(holds), F.lit(False))
        code, step = F.when(broken, F.lit(name)).otherwise(code), F.when(broken, F.lit(i)).otherwise(step)
    return df.withColumn("reason_code", code).withColumn("reason_step", step)


def attrition(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Per rule the rows it drops first and the rows left after it: ``step``, ``rule``, ``dropped``, ``remaining``."""
    counts = first_failing_rule(df, rules).groupBy("reason_step").agg(F.count("*").alias("n"))
    names = df.sparkSession.createDataFrame([(i, n) for i, (n, _) in enumerate(rules, 1)], "step int, rule string")
    total = df.agg(F.count("*").alias("total"))
    out = names.join(counts, F.col("step") == F.col("reason_step"), "left").select("step", "rule", F.coalesce("n", F.lit(0)).alias("dropped")).crossJoin(total)
    return out.select("step", "rule", "dropped", (F.col("total") - F.sum("dropped").over(Window.orderBy("step"))).alias("remaining"))  # one row per rule


def add_label(df: DataFrame, hours: int = 168) -> DataFrame:
    """``label`` 1 if unresolved after ``hours``, 0 if resolved within; null where the latest start is too early to tell."""
    snapshot = df.agg(F.max("start_ts").alias("snapshot"))
    due = F.expr(f"start_ts + interval {hours} hours")
    label = F.when(F.col("end_ts").isNotNull() & (F.col("end_ts") >= F.col("start_ts")), (F.col("end_ts") > due).cast("int")).when(F.col("end_ts").isNull() & (due <= F.col("snapshot")), 1)
    return df.crossJoin(F.broadcast(snapshot)).withColumn("label", label).drop("snapshot")


def location_key(parts: list[tuple[str, list[Column]]]) -> Column:
    """The first complete part as ``name:value|value``; a part is complete if all its columns are there."""
    out = []
    for name, cols in parts:
        whole = cols[0].isNotNull()
        for c in cols[1:]:
            whole = whole & c.isNotNull()
        out.append(F.when(whole, F.concat(F.lit(name + ":"), F.concat_ws("|", *cols))))
    return F.coalesce(*out)


def coverage_guard(windows: DataFrame, events: DataFrame, t: str = "t") -> DataFrame:
    """Windows (w_start, w_end) that reach outside the span of the events; must be empty."""
    span = events.agg(F.min(t).alias("first_t"), F.max(t).alias("last_t"))
    return windows.crossJoin(F.broadcast(span)).where("w_start < first_t or w_end > last_t").drop("first_t", "last_t")


def sparse_periods(df: DataFrame, ts: str, unit: str = "month", share: float = 0.5) -> DataFrame:
    """Periods whose row count is below ``share`` times the median period's."""
    n = df.groupBy(F.date_trunc(unit, F.col(ts)).cast("date").alias("period")).agg(F.count("*").alias("n"))
    return n.crossJoin(n.agg(F.median("n").alias("median_n"))).where(F.col("n") < share * F.col("median_n"))


def project_utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing in metres: the transverse Mercator series on the WGS 84 ellipsoid, northern zones."""
    a, e2, k0 = 6378137.0, 0.00669437999014, 0.9996
    ep = e2 / (1 - e2)
    phi, lam = F.radians(lat), F.radians(lon) - F.radians(F.lit(zone * 6 - 183))
    n, t, c = a / F.sqrt(1 - e2 * F.sin(phi) ** 2), F.tan(phi) ** 2, ep * F.cos(phi) ** 2
    u = F.cos(phi) * lam
    m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi) - (35 * e2**3 / 3072) * F.sin(6 * phi))
    x = k0 * n * (u + (1 - t + c) * u**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * ep) * u**5 / 120) + 500000
    y = k0 * (m + n * F.tan(phi) * (u**2 / 2 + (5 - t + 9 * c + 4 * c**2) * u**4 / 24 + (61 - 58 * t + t**2 + 600 * c - 330 * ep) * u**6 / 720))
    return x, y


def unproject_utm(x: Column, y: Column, zone: int) -> tuple[Column, Column]:
    """Longitude and latitude of a northern easting and northing: the inverse of ``project_utm``."""
    a, e2, k0 = 6378137.0, 0.00669437999014, 0.9996
    ep, e1 = e2 / (1 - e2), (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    mu = y / (k0 * a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    foot = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
    c, t, sin2 = ep * F.cos(foot) ** 2, F.tan(foot) ** 2, 1 - e2 * F.sin(foot) ** 2
    n, r = a / F.sqrt(sin2), a * (1 - e2) / sin2**1.5
    d = (x - 500000) / (n * k0)
    lat = foot - n * F.tan(foot) / r * (d**2 / 2 - (5 + 3 * t + 10 * c - 4 * c**2 - 9 * ep) * d**4 / 24 + (61 + 90 * t + 298 * c + 45 * t**2 - 252 * ep - 3 * c**2) * d**6 / 720)
    lon = (d - (1 + 2 * t + c) * d**3 / 6 + (5 - 2 * c + 28 * t - 3 * c**2 + 8 * ep + 24 * t**2) * d**5 / 120) / F.cos(foot)
    return F.degrees(lon) + (zone * 6 - 183), F.degrees(lat)


#: Conformal conic of Long Island on GRS 80 (fixed values): half axis, flattening, parallels, origin, false easting.
LONG_ISLAND = {"a": 6378137.0, "f": 1 / 298.257222101, "parallels": (41 + 2 / 60, 40 + 40 / 60), "lat0": 40 + 10 / 60, "lon0": -74.0, "x0": 300000.0}


def _conic(zone: dict) -> tuple[float, float, float, float]:
    """Eccentricity, exponent, scale and radius at the origin of a conic with two parallels."""
    e = math.sqrt(zone["f"] * (2 - zone["f"]))
    m = lambda deg: math.cos(math.radians(deg)) / math.sqrt(1 - (e * math.sin(math.radians(deg))) ** 2)
    t = lambda deg: math.tan(math.pi / 4 - math.radians(deg) / 2) * ((1 + e * math.sin(math.radians(deg))) / (1 - e * math.sin(math.radians(deg)))) ** (e / 2)
    one, two = zone["parallels"]
    n = (math.log(m(one)) - math.log(m(two))) / (math.log(t(one)) - math.log(t(two)))
    scale = zone["a"] * m(one) / (n * t(one) ** n)
    return e, n, scale, scale * t(zone["lat0"]) ** n


def project_lambert(lon: Column, lat: Column, zone: dict = LONG_ISLAND) -> tuple[Column, Column]:
    """Metres in a Lambert conformal conic with two parallels."""
    e, n, scale, rho0 = _conic(zone)
    phi = F.radians(lat)
    rho = scale * F.pow(F.tan(math.pi / 4 - phi / 2) * F.pow((1 + e * F.sin(phi)) / (1 - e * F.sin(phi)), e / 2), n)
    theta = n * (F.radians(lon) - math.radians(zone["lon0"]))
    return zone["x0"] + rho * F.sin(theta), rho0 - rho * F.cos(theta)


def unproject_lambert(x: Column, y: Column, zone: dict = LONG_ISLAND) -> tuple[Column, Column]:
    """Longitude and latitude, the inverse of ``project_lambert`` (five steps of the latitude's fixed point)."""
    e, n, scale, rho0 = _conic(zone)
    dx, dy = x - zone["x0"], rho0 - y
    t = F.pow(F.sqrt(dx**2 + dy**2) / scale, 1 / n)
    start = math.pi / 2 - 2 * F.atan(t)
    phi = F.aggregate(F.sequence(F.lit(1), F.lit(5)), start, lambda at, _: math.pi / 2 - 2 * F.atan(t * F.pow((1 - e * F.sin(at)) / (1 + e * F.sin(at)), e / 2)))
    return F.degrees(F.atan2(dx, dy) / n) + zone["lon0"], F.degrees(phi)


def display_text(address: Column, crossing: Column, street: Column, region: Column) -> Column:
    """Readable place: address, else crossing, else street, then the region; words capitalised."""
    return F.concat_ws(", ", F.initcap(F.coalesce(address, crossing, street)), F.initcap(region))
