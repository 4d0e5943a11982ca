"""Cohorts and co-location by shared address and phone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cohorts(providers: DataFrame, key: str, ident: str, sample: int = 10) -> DataFrame:
    """``(<key>, n, first_ids)``: how many rows share a key, and the first ``sample`` ids in order.

    The sample is a ranked limit, which every map task applies before the shuffle: of a key that a third
    of all rows share, each sends ``sample`` rows.
    """
    keyed = providers.where(f"{key} is not null").select(key, ident)
    counted = keyed.groupBy(key).agg(F.count("*").alias("n"))
    return counted.join(first_values(keyed, [key], ident, sample).withColumnRenamed("firsts", "first_ids"), key)


def first_values(rows: DataFrame, keys: list[str], value: str, sample: int) -> DataFrame:
    """``(<keys>, firsts)``: the first ``sample`` distinct values of each key, in order."""
    order = Window.partitionBy(*keys).orderBy(value)
    ranked = rows.where(F.col(value).isNotNull()).select(*keys, value).distinct().withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= sample)
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("firsts"))


def colocated_counts(entities: DataFrame, ident: str, address: str, phone: str) -> DataFrame:
    """``(<ident>, n_colocated, phone_shared)``: distinct other entities at one's address or phone, for those with any.

    By inclusion and exclusion over three group counts; pairs are never formed. Each entity has one address and one
    phone at most: of an id with several different rows the others would count once per row.
    """
    rows = entities.select(F.col(ident).alias("id"), F.col(address).alias("a"), F.col(phone).alias("p")).distinct()
    of = lambda keys, name: rows.dropna(subset=keys).groupBy(*keys).agg(F.count_distinct("id").alias(name))
    joined = rows.join(of(["a"], "na"), "a", "left").join(of(["p"], "np"), "p", "left").join(of(["a", "p"], "nap"), ["a", "p"], "left")
    total = F.coalesce("na", F.lit(0)) + F.coalesce("np", F.lit(0)) - F.coalesce("nap", F.lit(0))
    others = total - 1
    return joined.where("a is not null or p is not null").select(F.col("id").alias(ident), others.alias("n_colocated"), F.coalesce(F.col("np") > 1, F.lit(False)).alias("phone_shared")).where("n_colocated > 0")
