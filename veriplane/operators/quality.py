"""Parse-quality scores, structural fingerprints and run lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DATE_PATTERN = r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}"


def parse_score(name: Column, date: Column) -> Column:
    """1 less penalties: short name 0.4, date inside the name 0.3, no date 0.3 or an odd one 0.2, name over 80 characters 0.3; at least 0."""
    text, day = F.coalesce(name, F.lit("")), F.coalesce(date, F.lit(""))
    loss = (
        F.when(F.length(text) < 2, 0.4).otherwise(0.0)
        + F.when(text.rlike(DATE_PATTERN), 0.3).otherwise(0.0)
        + F.when(day == "", 0.3).when(~day.rlike("^" + DATE_PATTERN), 0.2).otherwise(0.0)
        + F.when(F.length(text) > 80, 0.3).otherwise(0.0)
    )
    return F.round(F.greatest(F.lit(0.0), 1 - loss), 6)


def fingerprint(pages: DataFrame, group: str, text: str) -> DataFrame:
    """Per group: pages, lines, mean lines a page, dates per line."""
    lines = F.size(F.split(F.col(text), "\n"))
    dates = F.regexp_count(F.col(text), F.lit(DATE_PATTERN))
    return pages.where(F.col(text).isNotNull()).groupBy(group).agg(
        F.count("*").alias("n_pages"), F.sum(lines).alias("n_lines"), F.round(F.avg(lines), 6).alias("lines_per_page"),
        F.round(F.sum(dates) / F.sum(lines), 6).alias("dates_per_line"),
    )


def header_share(pages: DataFrame, group: str, text: str, header: str) -> DataFrame:
    """``(<group>, n_pages, n_with_header, header_share)``: how many pages hold the header text."""
    has = F.count_if(F.contains(F.col(text), F.lit(header)))
    counted = pages.where(F.col(text).isNotNull()).groupBy(group).agg(F.count("*").alias("n_pages"), has.alias("n_with_header"))
    return counted.withColumn("header_share", F.round(F.col("n_with_header") / F.col("n_pages"), 6))


def parse_report(records: DataFrame, group: str, name: str, date: str, expected: tuple[int, int], reliable: float = 0.7, loss: float = 0.7, trusted: float = 0.8) -> DataFrame:
    """Per group: records, reliable ones (score ``reliable`` or more), whether their number drifted out of ``expected``, the overall confidence, and whether to trust it.

    The confidence is the share of reliable records, times ``loss`` on drift.
    """
    scored = records.select(group, parse_score(F.col(name), F.col(date)).alias("score"))
    counted = scored.groupBy(group).agg(F.count("*").alias("n_records"), F.count_if(F.col("score") >= reliable).alias("n_reliable"))
    drifted = ~F.col("n_records").between(*expected)
    overall = F.round(F.col("n_reliable") / F.col("n_records") * F.when(drifted, loss).otherwise(1.0), 6)
    return counted.select("*", drifted.alias("drifted"), overall.alias("confidence")).withColumn("trustworthy", (F.col("confidence") >= trusted) & ~F.col("drifted"))


def calibrate(judged: DataFrame, kind: str, right: Column, wrong: Column) -> DataFrame:
    """``(<kind>, n_true, n_false, precision)``: how often each kind was judged right; no precision without a verdict."""
    counts = judged.groupBy(kind).agg(F.count_if(right).alias("n_true"), F.count_if(wrong).alias("n_false"))
    total = F.col("n_true") + F.col("n_false")
    return counts.withColumn("precision", F.when(total > 0, F.round(F.col("n_true") / total, 6)))


def failure_runs(log: DataFrame, key: str, order: str, failed: Column) -> DataFrame:
    """``(<key>, longest_run)``: the longest run of consecutive failures of each key in log order."""
    w = Window.partitionBy(key).orderBy(order)
    marked = log.select(key, order, failed.cast("int").alias("bad")).withColumn("island", F.sum(1 - F.col("bad")).over(w))
    runs = marked.where("bad = 1").groupBy(key, "island").agg(F.count("*").alias("n"))
    return runs.groupBy(key).agg(F.max("n").alias("longest_run"))
