"""Exclusion events and what is known of each party from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriplane.functions.keys import blank_null, rfc3339_or_us_date, short_hash


def authority(source: Column) -> Column:
    """Issuing authority by the beginning of the source id, in this order."""
    return (
        F.when(source.startswith("hawaii_medquest"), "state_medicaid")
        .when(source.startswith("hawaii_dcca"), "state_license")
        .when(source.startswith("sam_gov"), "sam_gov")
        .otherwise("hhs_oig")
    )


def tier(name: Column) -> Column:
    """Independent oversight tier: the two federal lists are one."""
    return F.when(name.isin("hhs_oig", "sam_gov"), "federal").when(name == "state_medicaid", "state Medicaid").otherwise("state licensing")


def build_events(exclusions: DataFrame, entity: Column) -> DataFrame:
    """Events with at least one readable date, attributed to ``entity``."""
    begun, ended = rfc3339_or_us_date(F.col("exclusion_date")), rfc3339_or_us_date(F.col("reinstatement_date"))
    record = F.coalesce("source_record_id", "medicaid_provider_id", F.lit(""))
    dated = exclusions.select(
        entity.alias("entity_id"), authority(F.col("source_id")).alias("authority"), F.col("provider_type").alias("exclusion_type"),
        begun.alias("excluded_at"), ended.alias("reinstated_at"), F.coalesce("indefinite_exclusion", F.lit(False)).alias("indefinite"),
        blank_null(F.col("state")).alias("state"), "source_id", record.alias("record"),
    ).where("excluded_at is not null or reinstated_at is not null")
    status = F.when(F.col("indefinite"), "indefinite").when(F.col("reinstated_at").isNotNull(), "reinstated").otherwise("active")
    day = F.coalesce(F.date_format("excluded_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    event = short_hash(F.col("entity_id"), F.col("authority"), day, F.col("record"))
    return dated.select(event.alias("event_id"), "entity_id", "authority", "exclusion_type", "excluded_at", "reinstated_at", status.alias("status"), "state", "source_id")


def event_profile(events: DataFrame) -> DataFrame:
    """One row per entity: counts, distinct states and tiers, first and last dates, and whether it is excluded now."""
    last_in, last_out = F.max("excluded_at"), F.max("reinstated_at")
    now = F.coalesce(F.bool_or(F.col("status") == "indefinite"), F.lit(False)) | F.coalesce(last_in > last_out, last_in.isNotNull() & last_out.isNull())
    return events.groupBy("entity_id").agg(
        F.count("excluded_at").alias("n_exclusions"),
        F.count("reinstated_at").alias("n_reinstatements"),
        F.count_distinct(F.upper("state")).alias("n_states"),
        F.array_join(F.array_sort(F.collect_set(F.upper("state"))), ",").alias("states"),
        F.array_join(F.array_sort(F.collect_set(tier(F.col("authority")))), ",").alias("tiers"),
        F.min("excluded_at").alias("first_excluded"),
        last_in.alias("last_excluded"),
        now.alias("excluded_now"),
    )
