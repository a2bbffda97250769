"""Spreads, rhythms, monthly series, drift and alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.config import DEFAULT, Settings
from waymark.functions.geo import metres  # noqa: F401

HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000


def spread(df: DataFrame, by: list[str], measures: dict[str, Column]) -> DataFrame:
    """count, min, median (even counts average the middle), mean and max of each measure, a row per group and measure."""
    pairs = F.array(*(F.struct(F.lit(n).alias("measure"), c.cast("double").alias("value")) for n, c in measures.items()))
    return df.select(*by, F.inline(pairs)).filter("value is not null").groupBy(*by, "measure").agg(
        F.count("*").alias("n"), F.min("value").alias("least"), F.median("value").alias("median"), F.avg("value").alias("mean"), F.max("value").alias("most")
    )


def wall_hour(micros: Column) -> Column:
    return F.pmod(F.floor(micros / HOUR_US), F.lit(24)).cast("int")


def wall_weekday(micros: Column) -> Column:
    """Monday is 0; the epoch began on a Thursday."""
    return F.pmod(F.floor(micros / DAY_US) + 3, F.lit(7)).cast("int")


def in_hours(hour: Column, window: tuple[int, int]) -> Column:
    """Both ends included; a window may pass midnight."""
    lo, hi = window
    return hour.between(lo, hi) if lo <= hi else (hour >= lo) | (hour <= hi)


def histogram(df: DataFrame, by: str, value: Column, size: int) -> DataFrame:
    """Counts of 0..size-1 per group, zeros included."""
    groups = df.select(by).distinct().select(by, F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("slot"))
    counts = df.groupBy(by, value.alias("slot")).agg(F.count("*").alias("n"))
    return groups.join(counts, [by, "slot"], "left").select(by, "slot", F.coalesce("n", F.lit(0)).alias("n"))


def monthly(df: DataFrame, series: Column, at: Column) -> DataFrame:
    """(series, month, n): events per calendar month, silent months between first and last as zero."""
    counts = df.groupBy(series.alias("series"), F.trunc(at, "month").alias("month")).agg(F.count("*").alias("n"))
    span = counts.groupBy("series").agg(F.min("month").alias("a"), F.max("month").alias("b"))
    months = span.select("series", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return months.join(counts, ["series", "month"], "left").select("series", "month", F.coalesce("n", F.lit(0)).alias("n"))


def alignment(series: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Every pair of series over the months they share: number of months, relation and correlation (0 if one never moves)."""
    a, b = (series.select("month", F.col("series").alias(s), F.col("n").cast("double").alias(f"n_{s}")) for s in ("left", "right"))
    names = series.select("series").distinct()
    pairs = names.select(F.col("series").alias("left")).join(names.select(F.col("series").alias("right")), F.col("left") < F.col("right"))
    shared = a.join(b, "month").filter("left < right").groupBy("left", "right").agg(
        F.count("*").alias("months"), F.covar_pop("n_left", "n_right").alias("cov"), F.stddev_pop("n_left").alias("sa"), F.stddev_pop("n_right").alias("sb")
    )
    rows = pairs.join(shared, ["left", "right"], "left").withColumn("months", F.coalesce("months", F.lit(0)))
    known = F.col("months") >= cfg.drift_months
    rows = rows.withColumn("alignment", F.when(known & (F.col("sa") > 0) & (F.col("sb") > 0), F.try_divide("cov", F.col("sa") * F.col("sb"))).otherwise(0.0))
    kind = F.when(~known, "unknown").when(F.col("alignment") >= cfg.alignment, "co-occurring").when(F.col("alignment") <= -cfg.alignment, "divergent").otherwise("unrelated")
    return rows.select("left", "right", "months", kind.alias("relation"), "alignment")


def drift(series: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Each series of enough months against its own past: stage, latest value and baseline."""
    w = Window.partitionBy("series")
    rows = series.withColumns({"back": F.row_number().over(w.orderBy(F.desc("month"))), "months": F.count("*").over(w), "v": F.col("n").cast("double")})
    rows = rows.filter(F.col("months") >= cfg.drift_months).withColumn("recent", F.col("back") <= F.least(F.lit(cfg.persistent_months), F.floor(F.col("months") / 2)))
    base = rows.groupBy("series", "months").agg(
        F.avg(F.when(~F.col("recent"), F.col("v"))).alias("baseline"), F.stddev_pop(F.when(~F.col("recent"), F.col("v"))).alias("sigma"),
        F.max(F.when(F.col("back") == 1, F.col("v"))).alias("latest"), F.collect_list(F.when(F.col("recent"), F.col("v"))).alias("late"),
    )
    off, limit = F.abs(F.col("latest") - F.col("baseline")), cfg.drift_sigma * F.col("sigma")
    far = F.forall("late", lambda v: F.abs(v - F.col("baseline")) >= cfg.drift_sigma * F.col("sigma"))
    stage = (
        F.when(F.col("sigma") == 0, F.when(off == 0, "baseline").otherwise("new pattern"))
        .when(off < limit, "baseline").when(far, "persistent").when(off >= 2 * limit, "new pattern").otherwise("gradual")
    )
    return base.select("series", "months", stage.alias("stage"), "latest", "baseline")


def reach(outings: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Nearest-rank median and usual distance of outings with more than one stop, per owner."""
    w = Window.partitionBy("owner_id")
    rows = outings.filter("n_stops > 1").withColumns({"i": F.row_number().over(w.orderBy("km")) - 1, "n": F.count("*").over(w)})
    at = lambda p: F.max(F.when(F.col("i") == F.bround((F.col("n") - 1) * p).cast("int"), F.col("km")))
    return rows.groupBy("owner_id").agg(F.count("*").alias("n_outings"), at(0.5).alias("typical_km"), at(cfg.reach_share).alias("usual_km"))
