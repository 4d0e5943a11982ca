"""Excluded entities found among ownership records by normal name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriplane.functions.names import normalize_name
from veriplane.operators.places import first_values


def correlate(entities: DataFrame, owners: DataFrame, sample: int = 12) -> DataFrame:
    """Per entity the ownership rows of its normal name whose state and type agree or are unknown.

    Counts, whether a state agrees, and the first ``sample`` organizations in order.
    """
    left = entities.select("entity_id", "canonical_name", "entity_type", F.upper("canonical_state").alias("e_state"), normalize_name(F.col("canonical_name")).alias("norm")).where("norm <> ''").distinct()
    right = owners.select(normalize_name(F.col("owner_name")).alias("norm"), F.upper("owner_state").alias("o_state"), F.upper("owner_type").alias("o_type"), "provider_org_name").where("norm <> ''")
    # equal rows are counted before the join: one owner with a third of all rows is a few rows there
    right = right.groupBy("norm", "o_state", "o_type", "provider_org_name").agg(F.count("*").alias("n"))
    wanted = F.when(F.col("entity_type") == "individual", "I").when(F.col("entity_type") == "organization", "O")
    joined = left.join(right, "norm").where(F.coalesce(F.col("o_state") == F.col("e_state"), F.lit(True)) & F.coalesce(F.col("o_type") == wanted, F.lit(True)))
    grouped = joined.groupBy("entity_id", "canonical_name", "e_state", "entity_type").agg(
        F.sum("n").alias("owned_rows"), F.coalesce(F.bool_or(F.col("o_state") == F.col("e_state")), F.lit(False)).alias("state_agrees"),
        F.count_distinct("provider_org_name").alias("n_orgs"),
    )
    firsts = first_values(joined, ["entity_id"], "provider_org_name", sample)
    sample_text = F.coalesce(F.array_join("firsts", "|"), F.lit("")).alias("org_sample")
    return grouped.join(firsts, "entity_id", "left").select("entity_id", "canonical_name", "entity_type", "owned_rows", "state_agrees", "n_orgs", sample_text)
