"""Grouped views over usage, and the limit lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pricing import COUNTS, group_cost, total_tokens


def _sums() -> list[Column]:
    return [F.sum(c).cast("long").alias(c) for c in COUNTS]


def by_model(priced: DataFrame) -> DataFrame:
    """Counts and cost per model, the most used first, and a TOTAL row."""
    rows = priced.groupBy("model", "model_key", *(f"{c}_rate" for c in COUNTS)).agg(*_sums())
    views = rows.rollup("model").agg(F.grouping("model").alias("is_total"), *_sums(), *group_cost())
    out = views.select(F.when(F.col("is_total") == 1, "TOTAL").otherwise(F.col("model")).alias("model"), *COUNTS, total_tokens().alias("total"), "cost_usd", "partial", F.col("is_total").cast("int").alias("is_total"))
    return out.orderBy("is_total", F.desc("total"), "model")


def by_project(priced: DataFrame, project: str = "project") -> DataFrame:
    """Counts, cost and most used model per project; projects without usage are left out."""
    models = priced.groupBy(project, "model", "model_key", *(f"{c}_rate" for c in COUNTS)).agg(*_sums()).withColumn("total", total_tokens())
    top = F.max_by("model", F.struct("total", "model")).alias("top_model")
    out = models.groupBy(project).agg(F.sum("total").alias("total"), top, F.countDistinct("model").alias("models"), *group_cost()).where("total > 0")
    return out.orderBy(F.desc("total"), project)


def local_day(ts: Column, zone: str = "UTC") -> Column:
    """Calendar day of epoch milliseconds in a named zone."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_millis(ts), zone)) if zone != "UTC" else F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts / 86_400_000).cast("int"))


def by_day(priced: DataFrame, last_day: Column, days: int = 30, zone: str = "UTC") -> DataFrame:
    """Counts, cost and most used model per local day over the trailing window, newest first."""
    dated = priced.withColumn("day", local_day(F.col("ts"), zone)).where((F.col("day") > F.date_sub(last_day, days)) & (F.col("day") <= last_day))
    models = dated.groupBy("day", "model", "model_key", *(f"{c}_rate" for c in COUNTS)).agg(*_sums()).withColumn("total", total_tokens())
    top = F.max_by("model", F.struct("total", "model")).alias("top_model")
    return models.groupBy("day").agg(F.sum("total").alias("total"), top, *group_cost()).orderBy(F.desc("day"))


def unknown_models(usage: DataFrame, rates_of: DataFrame, most: int = 20) -> DataFrame:
    """Ids without a price: sessions that used them and the first harness that did; the ``most`` most common."""
    missing = usage.join(rates_of.where("model_key is not null").select("model").distinct(), "model", "left_anti")
    found = missing.groupBy("model").agg(F.countDistinct("session").alias("sessions"), F.min_by("harness", "ord").alias("harness"))
    return found.orderBy(F.desc("sessions"), "model").limit(most)


def repo_candidates(sessions: DataFrame) -> DataFrame:
    """Sessions, tokens and distinct local ids per repository slug."""
    return sessions.where("slug is not null").groupBy("slug").agg(F.count("*").alias("sessions"), F.sum("tokens").cast("long").alias("tokens"), F.array_sort(F.collect_set("local_id")).alias("local_ids"))


def harness_counts(sessions: DataFrame) -> DataFrame:
    """Sessions per harness that have any model; replay-only ones do not count."""
    return sessions.groupBy("harness").agg(F.count_if(F.col("models") > 0).alias("sessions"))


def most_used(counts: DataFrame) -> DataFrame:
    """The id with most invocations; ties go to the one seen first (``id, n, ord``)."""
    totals = counts.groupBy("id").agg(F.sum("n").alias("n"), F.min("ord").alias("first"))
    return totals.agg(F.max_by("id", F.struct("n", -F.col("first"))).alias("id"), F.max("n").alias("n"))


def mix_bar(rows: DataFrame, width: int, shown: int = 4) -> DataFrame:
    """Cells of a bar of ``width`` for the ``shown`` largest models and the rest, rounded cumulatively so that they fill it."""
    order = W.orderBy(F.desc("total"), "model")  # one row per model
    ranked = rows.select("model", "total", F.row_number().over(order).alias("rn"), F.count("*").over(W.partitionBy()).alias("n"), F.sum("total").over(W.partitionBy()).alias("all"))
    name = F.when(F.col("rn") <= shown, F.col("model")).otherwise(F.concat(F.lit("+"), F.col("n") - shown, F.lit(" more")))
    parts = ranked.groupBy(F.least(F.col("rn"), F.lit(shown + 1)).alias("part"), name.alias("model")).agg(F.sum("total").alias("total"), F.max("all").alias("all")).where("total > 0")
    upto = F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0))
    cells = parts.select("part", "model", "total", "all", F.floor(upto / F.col("all") * width + 0.5).alias("upto"))
    own = F.col("upto") - F.coalesce(F.lag("upto").over(W.orderBy("part")), F.lit(0))
    return cells.select("part", "model", own.alias("cells"), F.floor(F.col("total") / F.col("all") * 100 + 0.5).alias("share_pct")).where("cells > 0")


def agreement(ours: DataFrame, first: DataFrame, second: DataFrame, eps: float = 1e-9) -> DataFrame:
    """Each of our ids beside two catalogs (``model`` and rates; no row if a catalog is silent), and how far they agree.

    A catalog is held against ours in the rates that it states; the two against each other in input and output, which
    both must state, and in cache reads if both do.
    """
    fields = COUNTS[:3]
    joined = ours
    for prefix, t in (("a", first), ("b", second)):
        joined = joined.join(t.select("model", F.lit(True).alias(prefix), *(F.col(f"{c}_rate").cast("double").alias(f"{prefix}_{c}") for c in fields)), "model", "left")
    near = lambda x, y: F.coalesce(F.abs(x - y) < eps, F.lit(False))

    def holds(prefix: str) -> Column:
        out = F.lit(True)
        for c in fields:
            out = out & (F.col(f"{prefix}_{c}").isNull() | near(F.col(f"{prefix}_{c}"), F.col(f"{c}_rate").cast("double")))
        return F.col(prefix).isNull() | out

    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    cross = near(F.col("a_input"), F.col("b_input")) & near(F.col("a_output"), F.col("b_output"))
    cross = cross & (F.col("a_cache_read").isNull() | F.col("b_cache_read").isNull() | near(F.col("a_cache_read"), F.col("b_cache_read")))
    label = (
        F.when(F.col("a").isNull() & F.col("b").isNull(), "unobserved")
        .when(both & ~cross, "sources-disagree")
        .when(holds("a") & holds("b"), "all-agree")
        .otherwise("drifts-from-canonical")
    )
    return joined.select("model", label.alias("agreement"))


def drifted_rates(ours: DataFrame, catalog: DataFrame, eps: float = 1e-9) -> DataFrame:
    """``model, field, ours, theirs`` wherever the catalog carries an input, output or cache-read rate that differs from ours."""
    fields = COUNTS[:3]
    joined = ours.join(catalog.select("model", *(F.col(f"{c}_rate").alias(f"_{c}") for c in fields)), "model")
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"{c}_rate").cast("double").alias("ours"), F.col(f"_{c}").cast("double").alias("theirs")) for c in fields)))
    return joined.select("model", pairs.alias("p")).select("model", "p.*").where(F.abs(F.col("ours") - F.col("theirs")) > eps)


def health(rows: DataFrame, source: str, bad: Column) -> DataFrame:
    """Rows and unknown rows per source, and whether that suggests a changed format: over 20 and over 5 percent."""
    found = rows.groupBy(source).agg(F.count_if(bad).alias("unknown"), F.count("*").alias("total"))
    return found.withColumn("drift", (F.col("unknown") > 20) & (F.col("unknown") > F.col("total") * 0.05))


def limit_lanes(windows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Lanes of rate limits (``harness, minutes, scope, percent``) with label and group; a harness without any shows its estimate.

    ``estimate`` has ``harness, used``; its lanes have no percentage.
    """
    minutes = F.col("minutes")
    span = F.when(minutes == 300, "5h").when(minutes == 10_080, "weekly").otherwise(F.concat(F.floor(minutes / 60 + 0.5).cast("long").cast("string"), F.lit("h")))
    vendor = windows.select("harness", F.concat_ws(" ", "harness", F.coalesce("scope", span)).alias("label"), F.least(F.lit(100.0), F.greatest(F.lit(0.0), "percent")).alias("percent"), F.lit(False).alias("estimate"), F.when(minutes <= 1440, "SESSION").otherwise("WEEKLY").alias("lane_group"), F.lit(None).cast("long").alias("used"))
    own = estimate.join(windows.select("harness").distinct(), "harness", "left_anti")
    guessed = own.select("harness", F.concat(F.col("harness"), F.lit(" 5h window")).alias("label"), F.lit(None).cast("double").alias("percent"), F.lit(True).alias("estimate"), F.lit("SESSION").alias("lane_group"), "used")
    return vendor.unionByName(guessed)


def limits_panel(lanes: DataFrame, mode: str = "subscription", spent: float | None = None, budget: float | None = None) -> DataFrame:
    """Lanes by how usage is paid: paid per call there are no lanes, only the month's budget; mixed, both."""
    spark = lanes.sparkSession
    shown = lanes.where(F.lit(mode != "api"))
    if mode in ("api", "mix") and budget:
        share = min(100.0, max(0.0, (spent or 0.0) / budget * 100))
        gauge = spark.createDataFrame([("all", "monthly budget", share, False, "BUDGET", None)], "harness string, label string, percent double, estimate boolean, lane_group string, used long")
        shown = shown.unionByName(gauge)
    return shown
