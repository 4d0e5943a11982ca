"""The provider graph: exclusion rows resolved into entities, enriched from the registry, with events, candidates and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriplane.functions.keys import pair_of, rfc3339_or_us_date
from veriplane.functions.names import entity_type, normalize_name
from veriplane.operators.events import build_events
from veriplane.operators.places import first_values
from veriplane.operators.resolution import MERGE, _scored, components, modal, resolve_pairs
from veriplane.runtime import drop_stored, stored

PARTY = ["name", "npi", "state"]


def party_records(rows: DataFrame) -> DataFrame:
    """Distinct parties (name, npi, state) of rows with row_id: ``idx`` is their least row, ``n`` their number of rows.

    Rows with a blank name are left out.
    """
    named = rows.where("trim(name) <> ''").select("row_id", *PARTY).distinct()
    return named.groupBy(*PARTY).agg(F.min("row_id").alias("idx"), F.count("*").alias("n"))


def registry_rows(providers: DataFrame, order: str) -> DataFrame:
    """One row per number, the last by ``order``: (npi, active, deactivated, address, phone)."""
    kept = ["active", "deactivated", "address", "phone"]
    last = F.max(F.struct(F.col(order).alias("o"), *kept))
    return providers.where("npi is not null").groupBy("npi").agg(last.alias("r")).select("npi", *[F.col(f"r.{c}") for c in kept])


def active_cohorts(registry: DataFrame, excluded: DataFrame, keys: list[str], sample: int = 10) -> DataFrame:
    """``(<keys>, n, first_ids)``: active providers that are not excluded, at the places of those that are.

    ``excluded`` has the excluded numbers; its registry rows give the places asked for. The places are
    reduced to distinct ones first, counts and ranked samples are combined map-side, so a phone that a third of all providers share is no hot row.
    """
    targets = registry.join(excluded, "npi", "left_semi").dropna(subset=keys).select(*keys).distinct()
    free = registry.where("active").join(excluded, "npi", "left_anti").dropna(subset=keys).join(targets, keys, "left_semi").select(*keys, "npi")
    counted = free.groupBy(*keys).agg(F.count("*").alias("n"))
    return counted.join(first_values(free, keys, "npi", sample).withColumnRenamed("firsts", "first_ids"), keys)


def entity_ids(members: DataFrame) -> DataFrame:
    """``(cluster, entity_id)``: the smallest number of a cluster, else ``name:`` and its most frequent normal name."""
    named = modal(members.withColumn("norm", normalize_name(F.col("name"))), "cluster", "norm", "n")
    return members.groupBy("cluster").agg(F.min("npi").alias("npi")).join(named, "cluster", "left").select(
        "cluster", F.coalesce("npi", F.concat(F.lit("name:"), F.coalesce("norm", F.lit("")))).alias("entity_id")
    )


def merge_confirmed(clustered: DataFrame, ids: DataFrame, confirmed: DataFrame) -> DataFrame:
    """``(idx, cluster)`` after the clusters of confirmed pairs (entity_a, entity_b) are put together.

    A pair counts if both ends are entities here. Of clusters with one id the last stands for it.
    """
    of = ids.groupBy("entity_id").agg(F.max("cluster").alias("cluster"))
    end = lambda s: of.select(F.col("entity_id").alias(f"entity_{s}"), F.col("cluster").alias(f"cluster_{s}"))
    links = confirmed.join(end("a"), "entity_a").join(end("b"), "entity_b")
    joined = components(links, "cluster_a", "cluster_b")
    return clustered.join(joined, clustered["cluster"] == joined["id"], "left").select("idx", F.coalesce("component", "cluster").alias("cluster"))


def build_graph(rows: DataFrame, registry: DataFrame, verdicts: DataFrame, max_block: int = 400) -> dict[str, DataFrame]:
    """The tables of the graph: clusters, entity, exclusion_event, identity_link_candidate, meta.

    ``rows`` are exclusion rows (row_id, name, npi, state and the columns of ``build_events``), ``registry`` comes
    from ``registry_rows``, ``verdicts`` (entity_a, entity_b, verdict) holds the last verdict of each pair, a
    before b. Confirmed pairs merge clusters, rejected ones leave the candidates.

    An entity has the most frequent name and state of its rows, its numbers in order, and from the registry
    whether one of them is active, the earliest deactivation, and address and phone of the first number that has one.

    Defined cases: rows without row id or with a blank name are in no table; repeated rows count once; an empty table gives
    empty tables and a meta row of zeros. Parties without letters in their name stay alone; they share the id ``name:``.

    Scale: distinct parties rather than rows are compared; pairs meet in blocks of bounded size.
    """
    rows = rows.where("row_id is not null").dropDuplicates(["row_id"])
    records = stored(party_records(rows), "parties")
    scored = stored(_scored(records, max_block), "scored")
    first = stored(records.join(resolve_pairs(records, scored), "idx"), "first-clusters")
    merged = merge_confirmed(first.select("idx", "cluster"), entity_ids(first), verdicts.where("verdict = 'confirm'"))
    members = stored(records.join(merged, "idx"), "members")
    ids = stored(entity_ids(members), "ids")
    drop_stored(first)

    npis = members.where("npi is not null").select("cluster", "npi").distinct()
    info = npis.join(registry, "npi").groupBy("cluster").agg(
        F.bool_or("active").alias("npi_active"),
        F.min(F.date_format(rfc3339_or_us_date(F.col("deactivated")), "yyyy-MM-dd")).alias("npi_deactivation_date"),
        *[F.min(F.when(F.col(c).isNotNull(), F.struct("npi", c)))[c].alias(c) for c in ("address", "phone")],
    )
    excluded = npis.select("npi").distinct()
    entities = (
        members.groupBy("cluster").agg(F.sum("n").alias("n_rows"), F.array_sort(F.collect_set("npi")).alias("npis"))
        .join(ids, "cluster").join(modal(members, "cluster", "name", "n"), "cluster", "left").join(modal(members, "cluster", "state", "n"), "cluster", "left").join(info, "cluster", "left")
    )
    samples: list[Column] = []
    for name, keys in (("both", ["address", "phone"]), ("addr", ["address"]), ("phone", ["phone"])):
        cohort = active_cohorts(registry, excluded, keys).select(*keys, F.col("n").alias(f"{name}_cohort_active"), F.col("first_ids").alias(f"_{name}"))
        entities = entities.join(cohort, keys, "left")
        samples.append(F.coalesce(f"_{name}", F.array().cast("array<string>")))
    alone = (F.size("npis") > 0) | (F.col("n_rows") == 1)
    entity = entities.select(
        "cluster", "entity_id", entity_type(normalize_name(F.coalesce("name", F.lit("")))).alias("entity_type"), F.coalesce("name", F.lit("")).alias("canonical_name"),
        F.col("state").alias("canonical_state"), "npis", "npi_active", "npi_deactivation_date", F.col("address").alias("practice_address"), F.col("phone").alias("practice_phone"),
        "addr_cohort_active", "phone_cohort_active", "both_cohort_active",
        F.slice(F.array_sort(F.array_union(F.array_union(samples[0], samples[1]), samples[2])), 1, 10).alias("colocated_sample"),
        F.when(alone, 1.0).otherwise(0.85).alias("resolution_confidence"),
    )

    blank = lambda c: F.coalesce(c, F.lit(""))
    of = members.join(ids, "cluster").select("name", blank("npi").alias("npi"), blank("state").alias("state"), "entity_id")
    attributed = rows.withColumns({"npi": blank("npi"), "_state": F.col("state"), "state": blank("state")}).join(of, PARTY)
    event = build_events(attributed.withColumn("state", F.col("_state")), F.col("entity_id"))

    end = lambda s: members.join(ids, "cluster").select(F.col("idx").alias(s), F.col("entity_id").alias(f"entity_{s}"))
    a, b = pair_of(F.col("entity_i"), F.col("entity_j"))
    review = scored.where(F.col("raw") < MERGE).join(end("i"), "i").join(end("j"), "j").where("entity_i <> entity_j")
    best = F.min(F.struct((-F.round("raw", 4)).alias("doubt"), "i", "j", "signals"))
    candidate = review.select(a.alias("entity_a"), b.alias("entity_b"), "raw", "i", "j", "signals").groupBy("entity_a", "entity_b").agg(best.alias("r"))
    rejected = verdicts.where("verdict = 'reject'").select("entity_a", "entity_b")
    candidate = candidate.join(rejected, ["entity_a", "entity_b"], "left_anti").select("entity_a", "entity_b", (-F.col("r.doubt")).alias("confidence"), F.col("r.signals").alias("signals"))
    return {
        "clusters": members.select("idx", "cluster", "n"), "entity": entity, "exclusion_event": event, "identity_link_candidate": candidate,
        "meta": graph_totals(rows, members, entity, event, candidate),
    }


def graph_totals(rows: DataFrame, members: DataFrame, entity: DataFrame, event: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row: how many parties, merges, entities, events and candidates, the sources, and the states of entities."""
    sizes = members.agg(F.count("*").alias("party_count"), (F.count("*") - F.count_distinct("cluster")).alias("merge_count"))
    named = entity.agg(F.count("*").alias("entity_count"), F.array_sort(F.collect_set("canonical_state")).alias("jurisdiction_coverage"))
    events = event.agg(F.count("*").alias("exclusion_event_count"))
    links = candidate.agg(F.count("*").alias("candidate_count"))
    sources = rows.agg(F.array_sort(F.collect_set(F.when(F.trim("name") != "", F.col("source_id")))).alias("sources_ingested"))
    out = sizes.withColumn("_k", F.lit(1))
    for one in (named, events, links, sources):  # one row each
        out = out.join(one.withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k")
