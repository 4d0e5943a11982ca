"""Queries of the engine's own operators over the provider tables, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriplane.functions.codes import valid_npi
from veriplane.functions.keys import address_key, first_npi, fnv1a, pair_of, phone_key, rfc3339_or_us_date
from veriplane.functions.names import NOISE_TOKENS, ORG_TOKENS, entity_type, normalize_name, phonetic_keys
from veriplane.operators.correlation import correlate
from veriplane.operators.events import build_events, event_profile
from veriplane.operators.graph import active_cohorts, build_graph, registry_rows
from veriplane.operators.places import cohorts, colocated_counts
from veriplane.operators.quality import calibrate, failure_runs, fingerprint, header_share, parse_report, parse_score
from veriplane.operators.resolution import latest, modal, pair_scores, resolve
from veriplane.operators.snapshots import snapshot_changes
from veriplane.plans.general import SQL as GENERAL_SQL
from veriplane.runtime import table
from veriplane.sources.fetch import remaining
from veriplane.sources.lists import first_rows
from veriplane.sources.pages import HEALTH_BOARDS, licence_exclusions, licence_records, text_lines


def _entities(spark, folder):
    return table(spark, folder, "entities").dropDuplicates(["entity_id"])


def normalize_names(spark: SparkSession, folder: str) -> DataFrame:
    names = _entities(spark, folder).where("canonical_name is not null").select("entity_id", normalize_name(F.col("canonical_name")).alias("norm"))
    return names.select("entity_id", "norm", entity_type(F.col("norm")).alias("kind"))


def phonetic_key_counts(spark: SparkSession, folder: str) -> DataFrame:
    keys = _entities(spark, folder).select(F.explode(phonetic_keys(normalize_name(F.col("canonical_name")))).alias("phonetic_key"))
    return keys.groupBy("phonetic_key").agg(F.count("*").alias("n"))


def _rows(spark, folder):
    """Exclusion rows with the party's name, its number if valid, and its state."""
    npi = F.when(valid_npi(F.col("npi")), F.trim("npi"))
    return table(spark, folder, "exclusions").withColumns({"name": F.col("person_or_entity_name"), "npi": npi, "state": F.upper(F.trim("state"))})


def _records(spark, folder):
    """Distinct exclusion parties, their row number as index."""
    return _rows(spark, folder).where("name is not null").groupBy("name", "npi", "state").agg(F.min("row_id").alias("idx"))


def _registry(spark, folder):
    numbered = _entities(spark, folder).select(
        F.explode("npis").alias("npi"), "entity_id", F.coalesce("npi_active", F.lit(False)).alias("active"), F.col("npi_deactivation_date").alias("deactivated"),
        address_key(F.col("practice_address"), *[F.lit(None).cast("string")] * 3).alias("address"), phone_key(F.col("practice_phone")).alias("phone"),
    )
    return registry_rows(numbered, "entity_id")


def _graph(spark, folder):
    return build_graph(_rows(spark, folder), _registry(spark, folder), latest_verdicts(spark, folder).select("entity_a", "entity_b", "verdict"))


def graph_entities(spark: SparkSession, folder: str) -> DataFrame:
    """The entities that the exclusion rows resolve into, with what the registry knows of them."""
    return _flat(_graph(spark, folder)["entity"], "npis", "colocated_sample")


def _flat(rows: DataFrame, *arrays: str) -> DataFrame:
    """Arrays of text as one text."""
    return rows.withColumns({c: F.coalesce(F.array_join(c, ","), F.lit("")) for c in arrays})


def graph_events(spark: SparkSession, folder: str) -> DataFrame:
    """Every dated exclusion row as an event of the entity that its party resolves into."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return _graph(spark, folder)["exclusion_event"].select("event_id", "entity_id", "authority", "exclusion_type", day("excluded_at"), day("reinstated_at"), "status", "state", "source_id")


def graph_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of entities alike enough to be looked at, without those that were rejected."""
    return _flat(_graph(spark, folder)["identity_link_candidate"], "signals")


def graph_meta(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(_graph(spark, folder)["meta"], "jurisdiction_coverage", "sources_ingested")


def confirmed_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of parties after confirmed links have put some of them together."""
    return _graph(spark, folder)["clusters"].groupBy("cluster").agg(F.count("*").alias("n_parties"), F.sum("n").alias("n_rows"))


def _cohort(spark, folder, keys):
    excluded = _rows(spark, folder).where("npi is not null").select("npi").distinct()
    return _flat(active_cohorts(_registry(spark, folder), excluded, keys), "first_ids")


def cohorts_address(spark: SparkSession, folder: str) -> DataFrame:
    """Active providers that are not excluded, at the address of one that is."""
    return _cohort(spark, folder, ["address"])


def cohorts_phone(spark: SparkSession, folder: str) -> DataFrame:
    return _cohort(spark, folder, ["phone"])


def cohorts_both(spark: SparkSession, folder: str) -> DataFrame:
    return _cohort(spark, folder, ["address", "phone"])


def name_pair_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of record pairs that meet in a phonetic block."""
    return pair_scores(_records(spark, folder)).select("i", "j", F.round("score", 4).alias("score"), F.array_join("signals", ",").alias("signals"))


def resolved_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return resolve(_records(spark, folder)).groupBy("cluster").agg(F.count("*").alias("n_records"))


def best_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Highest confidence of each candidate pair, in either order."""
    a, b = pair_of(F.col("entity_a"), F.col("entity_b"))
    pairs = table(spark, folder, "link_candidates").where("entity_a <> entity_b").select(a.alias("entity_a"), b.alias("entity_b"), "confidence")
    return pairs.groupBy("entity_a", "entity_b").agg(F.max("confidence").alias("confidence"), F.count("*").alias("n_seen"))


def latest_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """The last log entry of each pair."""
    a, b = pair_of(F.col("entity_a"), F.col("entity_b"))
    log = table(spark, folder, "decisions").distinct().where("entity_a is not null and entity_b is not null").select(a.alias("entity_a"), b.alias("entity_b"), "log_pos", F.lower(F.trim("decision")).alias("verdict"))
    return latest(log, ["entity_a", "entity_b"], "log_pos")


def rejected_removed(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate pairs without those whose last verdict is reject."""
    rejected = latest_verdicts(spark, folder).where("verdict = 'reject'").select("entity_a", "entity_b")
    return best_candidates(spark, folder).join(rejected, ["entity_a", "entity_b"], "left_anti")


def review_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates with an end in one state, with names of both ends; an unknown id has an empty name."""
    known = _entities(spark, folder)
    end = lambda s: known.select(F.col("entity_id").alias(f"entity_{s}"), F.coalesce("canonical_name", F.lit("")).alias(f"name_{s}"), F.col("canonical_state").alias(f"state_{s}"))
    queue = best_candidates(spark, folder).join(end("a"), "entity_a", "left").join(end("b"), "entity_b", "left").where("upper(state_a) = 'HI' or upper(state_b) = 'HI'")
    return queue.select("entity_a", "entity_b", F.coalesce("name_a", F.lit("")).alias("name_a"), F.coalesce("name_b", F.lit("")).alias("name_b"), "confidence").orderBy(F.desc_nulls_last("confidence"), "entity_a", "entity_b")


def top_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """A report of the ten pairs of highest confidence."""
    return best_candidates(spark, folder).orderBy(F.desc_nulls_last("confidence"), "entity_a", "entity_b").limit(10)


def modal_names(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "exclusions").distinct().where("npi is not null and person_or_entity_name is not null").select("npi", F.col("person_or_entity_name").alias("name"))
    return modal(rows, "npi", "name")


def _party(name, npi):
    """Key of a party without resolution: its valid number, else ``name:`` and its normal name."""
    return F.coalesce(F.when(valid_npi(npi), F.trim(npi)), F.concat(F.lit("name:"), F.coalesce(normalize_name(name), F.lit(""))))


def _events(spark, folder):
    rows = table(spark, folder, "exclusions").dropDuplicates(["row_id"])
    return build_events(rows, _party(F.col("person_or_entity_name"), F.col("npi")))


def event_status_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).groupBy("authority", "status").agg(F.count("*").alias("n"), F.count("excluded_at").alias("n_excluded"), F.count("reinstated_at").alias("n_reinstated"))


def event_profiles(spark: SparkSession, folder: str) -> DataFrame:
    return event_profile(_events(spark, folder)).select("entity_id", "n_exclusions", "n_reinstatements", "n_states", "states", "tiers", "excluded_now")


def entity_event_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every entity with its number of events, none for most."""
    counted = _events(spark, folder).groupBy("entity_id").agg(F.count("*").alias("n_events"), F.count_if(F.col("status") == "active").alias("n_active"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return _entities(spark, folder).select("entity_id").join(counted, "entity_id", "left").select("entity_id", zero("n_events"), zero("n_active"))


def event_spans(spark: SparkSession, folder: str) -> DataFrame:
    """First and last exclusion of each party, by day."""
    profile = event_profile(_events(spark, folder))
    return profile.select("entity_id", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first_excluded", "last_excluded")])


def multi_tier_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Parties on record with two or more independent oversight tiers."""
    return event_profile(_events(spark, folder)).where(F.size(F.split("tiers", ",")) >= 2).select("entity_id", "tiers")


def entity_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """One row per party: rows, distinct sources and states, first and last arrival."""
    rows = table(spark, folder, "exclusions").dropDuplicates(["row_id"])
    return rows.groupBy(_party(F.col("person_or_entity_name"), F.col("npi")).alias("party")).agg(
        F.count("*").alias("n_rows"), F.array_join(F.array_sort(F.collect_set("source_id")), ",").alias("sources"),
        F.count_distinct(F.upper(F.trim("state"))).alias("n_states"), F.min("arrived_at").alias("first_arrival"), F.max("arrived_at").alias("last_arrival"),
    )


def excluded_registry_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Entities with a number that some exclusion row carries (semi-join on exploded numbers)."""
    wanted = table(spark, folder, "exclusions").select(F.trim("npi").alias("npi")).where("npi is not null").distinct()
    pairs = _entities(spark, folder).select("entity_id", "npi_active", F.explode("npis").alias("npi"))
    return pairs.join(wanted, "npi", "left_semi").select("entity_id", "npi", "npi_active")


def unmatched_exclusions(spark: SparkSession, folder: str) -> DataFrame:
    """Exclusion rows whose number no entity has (anti-join)."""
    known = table(spark, folder, "entities").select(F.explode("npis").alias("npi")).distinct()
    rows = table(spark, folder, "exclusions").where("npi is not null").select("row_id", F.trim("npi").alias("npi")).distinct()
    return rows.join(known, "npi", "left_anti")


def phone_cohorts(spark: SparkSession, folder: str) -> DataFrame:
    rows = _entities(spark, folder).where("npi_active").select("entity_id", phone_key(F.col("practice_phone")).alias("phone"))
    return cohorts(rows, "phone", "entity_id").select("phone", "n", F.array_join("first_ids", ",").alias("first_ids"))


def shared_locations(spark: SparkSession, folder: str) -> DataFrame:
    rows = _entities(spark, folder).select("entity_id", F.upper("practice_address").alias("address"), phone_key(F.col("practice_phone")).alias("phone"))
    return colocated_counts(rows, "entity_id", "address", "phone")


def owner_correlation(spark: SparkSession, folder: str) -> DataFrame:
    return correlate(_entities(spark, folder), table(spark, folder, "owners").distinct())


def verdict_calibration(spark: SparkSession, folder: str) -> DataFrame:
    """Per reviewer: last verdicts of pairs, and the share that confirm."""
    a, b = pair_of(F.col("entity_a"), F.col("entity_b"))
    log = table(spark, folder, "decisions").distinct().where("entity_a is not null and entity_b is not null").select(a.alias("a"), b.alias("b"), "log_pos", "reviewer", F.lower(F.trim("decision")).alias("verdict"))
    counts = latest(log, ["a", "b"], "log_pos").groupBy("reviewer").agg(F.count_if(F.col("verdict") == "confirm").alias("n_confirm"), F.count_if(F.col("verdict") == "reject").alias("n_reject"))
    total = F.col("n_confirm") + F.col("n_reject")
    return counts.select("reviewer", "n_confirm", "n_reject", F.when(total > 0, F.round(F.col("n_confirm") / total, 6)).alias("precision"))


def rejection_runs(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "decisions").distinct().where("reviewer is not null")
    return failure_runs(log, "reviewer", "log_pos", F.coalesce(F.lower(F.trim("decision")) == "reject", F.lit(False)))


def run_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Changes per pair of consecutive runs and kind."""
    changes = snapshot_changes(table(spark, folder, "signal_rows"), "run_no", "signal_id", "line_no", ["reason_code"], {"confidence": 1e-9})
    return changes.groupBy("from_run", "to_run", "change_kind").agg(F.count("*").alias("n"))


def run_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of each run by reason code, and how many types they are of."""
    return table(spark, folder, "signal_rows").groupBy("run_no", "reason_code").agg(F.count("*").alias("n_lines"), F.count_distinct("signal_type").alias("n_types"), F.count_if(F.col("confidence") >= 0.7).alias("n_high"))


def address_keys(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "address_claims").distinct()
    return rows.select("claim_id", address_key(F.col("address_1"), F.col("city"), F.col("state"), F.col("zip_code")).alias("address_key"))


def phone_keys(spark: SparkSession, folder: str) -> DataFrame:
    return _entities(spark, folder).select("entity_id", phone_key(F.col("practice_phone")).alias("phone"))


def normalized_dates(spark: SparkSession, folder: str) -> DataFrame:
    """RFC 3339 and month-first dates; every other form is null here (p7_found reads them all)."""
    rows = table(spark, folder, "exclusions").select("row_id", "exclusion_date").distinct()
    return rows.select("row_id", F.date_format(rfc3339_or_us_date(F.col("exclusion_date")), "yyyy-MM-dd").alias("day")).where("day is not null")


def parse_quality(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "exclusions").dropDuplicates(["row_id"]).withColumn("score", parse_score(F.col("person_or_entity_name"), F.col("exclusion_date")))
    return rows.groupBy("source_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("score") >= 0.7).alias("n_reliable"), F.round(F.avg("score"), 6).alias("mean_score"))


def text_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint(table(spark, folder, "documents"), "doc_kind", "text")


def union_sources(spark: SparkSession, folder: str) -> DataFrame:
    """All sources put together, a part for each kind of list; a column that one lacks is null."""
    rows = table(spark, folder, "exclusions").dropDuplicates(["row_id"])
    kinds = {"leie": [], "sam_gov": ["state", "medicaid_provider_id"], "hawaii": ["npi"]}  # and what each kind of list does not carry
    listed = F.lit(False)
    out = None
    for prefix, lacking in kinds.items():
        mine = F.coalesce(F.col("source_id").startswith(prefix), F.lit(False))
        part = rows.where(mine).drop(*lacking)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        listed = listed | mine
    return out.unionByName(rows.where(~listed)).drop("arrived_at", "observed_at")


def source_statistics(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "exclusions")
    return rows.groupBy("source_id").agg(
        F.count("*").alias("n_rows"), F.count_if(valid_npi(F.col("npi"))).alias("n_valid_npi"), F.count_if(F.col("indefinite_exclusion")).alias("n_indefinite"),
        F.count_if(F.coalesce(F.trim("person_or_entity_name"), F.lit("")) == "").alias("n_nameless"),
    )


def jurisdiction_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Entities of one state, by their own or by any of their exclusion rows, which they share a number or a name with."""
    rows = table(spark, folder, "exclusions").where("upper(trim(state)) = 'HI'")
    keys = rows.select(F.explode(F.array(F.trim("npi"), F.concat(F.lit("name:"), normalize_name(F.col("person_or_entity_name"))))).alias("key")).where("key is not null and key <> 'name:'").distinct()
    own = F.when(F.startswith("entity_id", F.lit("name:")), F.array(F.concat(F.lit("name:"), normalize_name(F.substr("entity_id", F.lit(6)))))).otherwise(F.array().cast("array<string>"))
    known = _entities(spark, folder).select("entity_id", F.upper("canonical_state").alias("state"), F.explode_outer(F.concat(F.coalesce("npis", F.array().cast("array<string>")), own)).alias("key"))
    hit = known.join(keys.withColumn("hit", F.lit(True)), "key", "left")
    return hit.groupBy("entity_id").agg(F.bool_or((F.coalesce("state", F.lit("")) == "HI") | F.coalesce("hit", F.lit(False))).alias("inside")).where("inside").select("entity_id")


def _verdict_counts(spark, folder):
    """Per signal type: pairs with that signal whose last verdict is confirm, and reject; and the share that confirm."""
    a, b = pair_of(F.col("entity_a"), F.col("entity_b"))
    fired = table(spark, folder, "link_candidates").where("entity_a <> entity_b").select(a.alias("entity_a"), b.alias("entity_b"), F.explode("signals").alias("signal_type")).distinct()
    judged = fired.join(latest_verdicts(spark, folder).select("entity_a", "entity_b", "verdict"), ["entity_a", "entity_b"])
    return calibrate(judged, "signal_type", F.col("verdict") == "confirm", F.col("verdict") == "reject")


def signal_calibration(spark: SparkSession, folder: str) -> DataFrame:
    """How often each signal was right, by the verdicts, with a line to print."""
    counts = _verdict_counts(spark, folder)
    return counts.withColumn("line", F.format_string("%s: %d of %d confirmed", "signal_type", "n_true", F.col("n_true") + F.col("n_false")))


def calibrated_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate pairs with the best calibrated precision among their signals; signals without verdicts have none."""
    a, b = pair_of(F.col("entity_a"), F.col("entity_b"))
    fired = table(spark, folder, "link_candidates").where("entity_a <> entity_b").select(a.alias("entity_a"), b.alias("entity_b"), F.explode_outer("signals").alias("signal_type")).distinct()
    known = _verdict_counts(spark, folder).select("signal_type", "precision")
    return fired.join(known, "signal_type", "left").groupBy("entity_a", "entity_b").agg(F.count("signal_type").alias("n_signals"), F.max("precision").alias("best_precision"))


def ranked_owner_findings(spark: SparkSession, folder: str) -> DataFrame:
    """A report of the ten strongest findings: those whose state agrees first, then the most rows."""
    return owner_correlation(spark, folder).orderBy(F.desc("state_agrees"), F.desc("owned_rows"), "entity_id").limit(10).select("entity_id", "state_agrees", "owned_rows")


def uncorroborated_owners(spark: SparkSession, folder: str) -> DataFrame:
    """How many findings rest on an individual's name alone, by entity type."""
    return owner_correlation(spark, folder).groupBy("entity_type").agg(F.count("*").alias("n"), F.count_if(~F.col("state_agrees")).alias("n_name_only"))


def provider_types(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "owners").where("provider_type is not null").groupBy("provider_type").agg(F.count("*").alias("n_rows")).orderBy("provider_type")


def first_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The first three edges of each provider type, as a limit per type gives them."""
    return first_rows(table(spark, folder, "owners").select("provider_type", "edge_id", "owner_name").distinct(), ["provider_type"], ["edge_id"], 3)


def name_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return _entities(spark, folder).select("entity_id", fnv1a(normalize_name(F.col("canonical_name"))).alias("hash"))


def embedded_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """The first number of ten digits in each raw line."""
    return table(spark, folder, "raw_records").select("record_id", first_npi(F.col("raw_line")).alias("number")).where("number is not null").distinct()


def text_line_counts(spark: SparkSession, folder: str) -> DataFrame:
    lines = text_lines(table(spark, folder, "documents"), "doc_id", "text")
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def header_shares(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents of a kind name a Case, as a header would."""
    return header_share(table(spark, folder, "documents"), "doc_kind", "text", "Case")


def parse_reports(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "exclusions").dropDuplicates(["row_id"])
    return parse_report(rows, "source_id", "person_or_entity_name", "exclusion_date", (100, 100_000))


def unseen_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Signals of the last run that no earlier run had: what a resumed job has left to do."""
    lines = table(spark, folder, "signal_rows").where("coalesce(signal_id, '') <> '' and run_no is not null").select("run_no", "signal_id").distinct()
    last = lines.agg(F.max("run_no").alias("last"))  # one row
    marked = lines.join(F.broadcast(last), F.col("run_no") <= F.col("last"))
    return remaining(marked.where("run_no = last").select("signal_id"), marked.where("run_no < last"), "signal_id")


def licence_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Every exclusion row rendered as a licence page and read back: boards, labels, aliases, sanctions and dates."""
    rows = table(spark, folder, "exclusions").where("trim(person_or_entity_name) <> ''").dropDuplicates(["row_id"])
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(
        F.lit("<h2>BOARD OF "), F.upper(safe(F.col("provider_type"))), F.lit(" MEDICINE</h2><p>Respondent: "), safe(F.col("person_or_entity_name")),
        F.lit("</p><p>Case Number:</p><p>C-"), F.col("row_id").cast("string"), F.lit("</p><p>Sanction: "),
        F.when(F.col("indefinite_exclusion"), "License revoked").when(F.col("indefinite_exclusion").isNull(), "Fine").otherwise("Suspension"), F.lit("</p><p>Effective Date: 3-04-"),
        F.lpad((F.col("row_id") % 100).cast("string"), 2, "0"), F.lit("</p>"),
    )
    records = licence_records(text_lines(rows.select("row_id", page.alias("html")), "row_id", "html"), "row_id")
    return licence_exclusions(records, "row_id", "hawaii_dcca_actions", "HI").select("person_or_entity_name", "exclusion_date", "source_record_id", "provider_type", "indefinite_exclusion")


_FUNCTIONS = [
    normalize_names, phonetic_key_counts, name_pair_scores, resolved_clusters, best_candidates, latest_verdicts, rejected_removed, review_queue,
    top_candidates, modal_names, event_status_counts, event_profiles, multi_tier_entities, entity_rollup, excluded_registry_rows, unmatched_exclusions,
    phone_cohorts, shared_locations, owner_correlation, verdict_calibration, rejection_runs, run_changes, run_totals, address_keys, phone_keys,
    normalized_dates, parse_quality, text_fingerprints, union_sources, source_statistics, jurisdiction_entities,
    entity_event_counts, event_spans, signal_calibration, calibrated_candidates, ranked_owner_findings, uncorroborated_owners, provider_types, first_edges, name_hashes, embedded_numbers,
    text_line_counts, header_shares, parse_reports, unseen_signals, licence_round_trip,
    graph_entities, graph_events, graph_candidates, graph_meta, confirmed_clusters, cohorts_address, cohorts_phone, cohorts_both,
]
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_NOISE = ", ".join(f"'{t}'" for t in NOISE_TOKENS)
_ORG = ", ".join(f"'{t}'" for t in ORG_TOKENS)
_NORM = lambda c: f"array_to_string(list_filter(string_split(trim(upper(regexp_replace({c}, '[^A-Za-z]+', ' ', 'g'))), ' '), lambda t: t NOT IN ({_NOISE}, '')), ' ')"
_ENT = "ent AS (SELECT DISTINCT ON (entity_id) * FROM entities)"
_NPI_OK = (
    "(regexp_full_match(trim(npi), '[0-9]{10}') AND (24 + list_sum(list_transform(generate_series(1, 10), lambda i: "
    "CASE WHEN i % 2 = 1 THEN (2 * ord(substr(trim(npi), i, 1)) - 96) // 10 + (2 * ord(substr(trim(npi), i, 1)) - 96) % 10 "
    "ELSE ord(substr(trim(npi), i, 1)) - 48 END))) % 10 = 0)"
)
_PHONE = "CASE WHEN length(regexp_replace({c}, '[^0-9]', '', 'g')) >= 10 THEN right(regexp_replace({c}, '[^0-9]', '', 'g'), 10) END".format
_EX = "ex AS (SELECT DISTINCT ON (row_id) * FROM exclusions)"
_DATE = lambda c: f"""coalesce(  -- noqa
  CASE WHEN regexp_matches({c}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[Tt ][0-9]{{2}}:[0-9]{{2}}.*([Zz]|[+-][0-9]{{2}}:[0-9]{{2}})$') THEN try_cast(upper({c}) AS TIMESTAMPTZ) AT TIME ZONE 'UTC' END,
  CASE WHEN regexp_full_match({c}, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}') THEN try_strptime({c}, '%m/%d/%Y')
       WHEN regexp_full_match({c}, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2}}') THEN try_strptime(regexp_replace({c}, '/([0-9]{{2}})$', CASE WHEN right({c}, 2) >= '70' THEN '/19\\1' ELSE '/20\\1' END), '%m/%d/%Y') END)""".replace("  -- noqa", "")  # noqa: E731
_PARTY = f"CASE WHEN {_NPI_OK} THEN trim(npi) ELSE 'name:' || coalesce({_NORM('person_or_entity_name')}, '') END"
_EVENTS = f"""{_EX}, ev0 AS (
  SELECT {_PARTY} AS entity_id,
         CASE WHEN starts_with(source_id, 'hawaii_medquest') THEN 'state_medicaid' WHEN starts_with(source_id, 'hawaii_dcca') THEN 'state_license'
              WHEN starts_with(source_id, 'sam_gov') THEN 'sam_gov' ELSE 'hhs_oig' END AS authority,
         {_DATE('exclusion_date')} AS excluded_at, {_DATE('reinstatement_date')} AS reinstated_at,
         coalesce(indefinite_exclusion, false) AS indefinite, nullif(trim(state), '') AS state
  FROM ex),
ev AS (SELECT *, CASE WHEN indefinite THEN 'indefinite' WHEN reinstated_at IS NOT NULL THEN 'reinstated' ELSE 'active' END AS status,
              CASE WHEN authority IN ('hhs_oig', 'sam_gov') THEN 'federal' WHEN authority = 'state_medicaid' THEN 'state Medicaid' ELSE 'state licensing' END AS tier
       FROM ev0 WHERE excluded_at IS NOT NULL OR reinstated_at IS NOT NULL)"""
_PROFILE = f"""{_EVENTS}, prof AS (
  SELECT entity_id, count(excluded_at) AS n_exclusions, count(reinstated_at) AS n_reinstatements, count(DISTINCT upper(state)) AS n_states,
         coalesce(string_agg(DISTINCT upper(state), ',' ORDER BY upper(state)), '') AS states, string_agg(DISTINCT tier, ',' ORDER BY tier) AS tiers,
         bool_or(status = 'indefinite') OR coalesce(max(excluded_at) > max(reinstated_at), max(excluded_at) IS NOT NULL AND max(reinstated_at) IS NULL) AS excluded_now
  FROM ev GROUP BY entity_id)"""
_BEST = """best AS (SELECT least(entity_a, entity_b) AS entity_a, greatest(entity_a, entity_b) AS entity_b, max(confidence) AS confidence, count(*) AS n_seen
  FROM link_candidates WHERE entity_a <> entity_b GROUP BY 1, 2)"""
_LAST = """last AS (SELECT entity_a, entity_b, log_pos, verdict, reviewer FROM (
    SELECT least(entity_a, entity_b) AS entity_a, greatest(entity_a, entity_b) AS entity_b, log_pos, lower(trim(decision)) AS verdict, reviewer,
           row_number() OVER (PARTITION BY least(entity_a, entity_b), greatest(entity_a, entity_b) ORDER BY log_pos DESC) AS rn
    FROM (SELECT DISTINCT * FROM decisions) WHERE entity_a IS NOT NULL AND entity_b IS NOT NULL) WHERE rn = 1)"""
_PHONETIC = """
  stems AS (SELECT *, CASE WHEN substr(w, 1, 2) IN ('AE', 'GN', 'KN', 'PN', 'WR') THEN substr(w, 2) ELSE w END AS stem FROM words),
  bare AS (SELECT *, string_split(substr(stem, 1, 1) || regexp_replace(substr(stem, 2), '[AEIOU]', '', 'g'), '') AS c FROM stems),
  keys AS (SELECT *, substr(array_to_string(list_transform(list_filter(generate_series(1, len(c)), lambda i: i = 1 OR c[i] <> c[i - 1]), lambda i: c[i]), ''), 1, 6) AS key FROM bare)"""
_PAIRS = f"""party AS (SELECT person_or_entity_name AS name, CASE WHEN {_NPI_OK} THEN trim(npi) END AS npi, upper(trim(state)) AS state, row_id FROM exclusions),
  rec AS (SELECT name, npi, state, min(row_id) AS idx, count(DISTINCT row_id) AS n FROM party WHERE name IS NOT NULL GROUP BY 1, 2, 3),
  feat AS (SELECT *, {_NORM('name')} AS norm FROM rec),
  words AS (SELECT idx, unnest(list_distinct(string_split(norm, ' '))) AS w FROM feat WHERE norm <> ''), {_PHONETIC},
  kk AS (SELECT DISTINCT idx, key FROM keys WHERE length(w) > 1),
  ok AS (SELECT key FROM kk GROUP BY key HAVING count(*) BETWEEN 2 AND 400),
  sets AS (SELECT f.*, list_distinct(list_filter(string_split(norm, ' '), lambda t: t <> '')) AS ws,
                  coalesce((SELECT list(key) FROM kk WHERE kk.idx = f.idx), []) AS ks FROM feat f),
  pairs AS (SELECT DISTINCT a.idx AS i, b.idx AS j FROM kk a JOIN ok USING (key) JOIN kk b ON a.key = b.key AND a.idx < b.idx),
  sim AS (SELECT i, j, a.norm AS x, b.norm AS y,
      len(list_intersect(a.ws, b.ws)) AS wi, len(list_distinct(a.ws || b.ws)) AS wu, least(len(a.ws), len(b.ws)) AS wm,
      len(list_intersect(a.ks, b.ks)) AS ki, len(list_distinct(a.ks || b.ks)) AS ku,
      CASE WHEN lower(a.state) = lower(b.state) THEN 0.05::DOUBLE ELSE 0::DOUBLE END AS bonus
    FROM pairs JOIN sets a ON a.idx = i JOIN sets b ON b.idx = j
    WHERE a.norm <> b.norm AND NOT (a.npi IS NOT NULL AND b.npi IS NOT NULL AND a.npi <> b.npi)),
  parts AS (SELECT i, j, bonus, 1 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)) AS edit,
      greatest(CASE WHEN wu > 0 THEN wi::DOUBLE / wu ELSE 0 END, 0.9::DOUBLE * CASE WHEN wm > 0 THEN wi::DOUBLE / wm ELSE 0 END) AS token,
      CASE WHEN ku > 0 THEN ki::DOUBLE / ku ELSE 0 END AS phon FROM sim),
  scored AS MATERIALIZED (SELECT *, least(1::DOUBLE, 0.6::DOUBLE * edit + 0.25::DOUBLE * token + 0.15::DOUBLE * phon + bonus) AS s FROM parts WHERE
      least(1::DOUBLE, 0.6::DOUBLE * edit + 0.25::DOUBLE * token + 0.15::DOUBLE * phon + bonus) >= 0.72)"""
_FIRED = """array_to_string(list_filter([CASE WHEN edit > 0.6 THEN 'name_edit_distance' END, CASE WHEN token > 0.5 THEN 'name_token_overlap' END,
            CASE WHEN phon > 0.5 THEN 'name_phonetic' END, CASE WHEN bonus > 0 THEN 'state_match' END], lambda v: v IS NOT NULL), ',')"""
_BASE = """one_npi AS (SELECT npi, min(idx) AS anchor FROM feat WHERE npi IS NOT NULL GROUP BY 1),
  one_norm AS (SELECT norm, min(idx) AS anchor, arg_min(struct_pack(npi := npi), idx).npi AS a_npi FROM feat WHERE norm <> '' GROUP BY 1),
  links AS (SELECT idx AS u, anchor AS v FROM feat JOIN one_npi USING (npi)
            UNION SELECT idx, anchor FROM feat JOIN one_norm USING (norm) WHERE NOT (npi IS NOT NULL AND a_npi IS NOT NULL AND npi <> a_npi)
            UNION SELECT i, j FROM scored WHERE s >= 0.9),
  ends AS MATERIALIZED (SELECT u, v FROM links UNION SELECT v, u FROM links),
  reach AS (SELECT idx AS id, idx AS r FROM feat UNION SELECT reach.id, ends.v FROM reach JOIN ends ON reach.r = ends.u),
  base AS MATERIALIZED (SELECT id AS idx, min(r) AS cluster FROM reach GROUP BY 1)"""
_TOP = lambda c: f"row_number() OVER (PARTITION BY cluster ORDER BY sum(n) DESC, strlen({c}) DESC, {c}) = 1"
_IDS = """{0}_norm AS (SELECT cluster, norm FROM {0} WHERE norm <> '' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY sum(n) DESC, strlen(norm) DESC, norm) = 1),
  {0}_ids AS MATERIALIZED (SELECT m.cluster, coalesce(min(m.npi), 'name:' || coalesce(min(k.norm), '')) AS entity_id FROM {0} m LEFT JOIN {0}_norm k USING (cluster) GROUP BY 1)"""
# the graph leaves out parties without a name; the rest is resolved as before
_GRAPH = f"""{_PAIRS.replace("WHERE name IS NOT NULL", "WHERE trim(name) <> ''")}, {_BASE}, {_LAST},
  early AS MATERIALIZED (SELECT f.*, cluster FROM feat f JOIN base USING (idx)), {_IDS.format("early")},
  rep AS (SELECT entity_id, max(cluster) AS cluster FROM early_ids GROUP BY 1),
  joins AS (SELECT a.cluster AS u, b.cluster AS v FROM last JOIN rep a ON a.entity_id = entity_a JOIN rep b ON b.entity_id = entity_b WHERE verdict = 'confirm'),
  both_ways AS MATERIALIZED (SELECT u, v FROM joins UNION SELECT v, u FROM joins),
  spread AS (SELECT DISTINCT cluster AS id, cluster AS r FROM early UNION SELECT spread.id, b.v FROM spread JOIN both_ways b ON spread.r = b.u),
  final AS (SELECT id, min(r) AS cluster FROM spread GROUP BY 1),
  member AS MATERIALIZED (SELECT e.idx, e.name, e.npi, e.state, e.norm, e.n, f.cluster FROM early e JOIN final f ON f.id = e.cluster), {_IDS.format("member")}"""
_ADDRESS_OF = "nullif(trim(regexp_replace(regexp_replace(upper(practice_address), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), '')"
_REG = f"""{_ENT}, reg AS MATERIALIZED (SELECT * FROM (
    SELECT unnest(npis) AS npi, entity_id, coalesce(npi_active, false) AS active, npi_deactivation_date AS deactivated, {_ADDRESS_OF} AS address, {_PHONE(c='practice_phone')} AS phone FROM ent)
  WHERE npi IS NOT NULL QUALIFY row_number() OVER (PARTITION BY npi ORDER BY entity_id DESC) = 1)"""
_EXCLUDED = f"excluded AS (SELECT DISTINCT trim(npi) AS npi FROM exclusions WHERE {_NPI_OK})"


def _COHORT(*keys):
    cols, known = ", ".join(keys), " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return f"""cohort_{'_'.join(keys)} AS (SELECT {cols}, count(*) AS n, array_to_string(list_slice(list_sort(list(DISTINCT npi)), 1, 10), ',') AS first_ids FROM reg
      WHERE active AND {known} AND npi NOT IN (SELECT npi FROM excluded) AND ({cols}) IN (SELECT ({cols}) FROM reg WHERE {known} AND npi IN (SELECT npi FROM excluded)) GROUP BY {cols})"""


_ENTITY = f"""{_REG}, excluded AS (SELECT DISTINCT npi FROM member WHERE npi IS NOT NULL), {_COHORT('address')}, {_COHORT('phone')}, {_COHORT('address', 'phone')},
  info AS (SELECT cluster, bool_or(active) AS npi_active, min(strftime({_DATE('deactivated')}, '%Y-%m-%d')) AS npi_deactivation_date,
                  arg_min(address, npi) FILTER (address IS NOT NULL) AS address, arg_min(phone, npi) FILTER (phone IS NOT NULL) AS phone
           FROM (SELECT DISTINCT cluster, npi FROM member WHERE npi IS NOT NULL) JOIN reg USING (npi) GROUP BY 1),
  named AS (SELECT cluster, name FROM member GROUP BY 1, 2 QUALIFY {_TOP('name')}),
  stated AS (SELECT cluster, state FROM member WHERE trim(state) <> '' GROUP BY 1, 2 QUALIFY {_TOP('state')}),
  whole AS (SELECT cluster, sum(n) AS n, coalesce(string_agg(DISTINCT npi, ',' ORDER BY npi), '') AS npis FROM member GROUP BY 1),
  entity AS (SELECT w.cluster, entity_id, CASE WHEN list_has_any(string_split({_NORM('name')}, ' '), [{_ORG}]) THEN 'organization' ELSE 'individual' END AS entity_type,
      name AS canonical_name, state AS canonical_state, npis, npi_active, npi_deactivation_date, i.address AS practice_address, i.phone AS practice_phone,
      a.n AS addr_cohort_active, p.n AS phone_cohort_active, b.n AS both_cohort_active,
      array_to_string(list_slice(list_sort(list_distinct(list_filter(string_split(concat_ws(',', nullif(a.first_ids, ''), nullif(p.first_ids, ''), nullif(b.first_ids, '')), ','), lambda x: x <> ''))), 1, 10), ',') AS colocated_sample,
      CASE WHEN npis <> '' OR w.n = 1 THEN 1::DOUBLE ELSE 0.85::DOUBLE END AS resolution_confidence
    FROM whole w JOIN member_ids USING (cluster) JOIN named USING (cluster) LEFT JOIN stated USING (cluster) LEFT JOIN info i USING (cluster)
    LEFT JOIN cohort_address a ON a.address = i.address LEFT JOIN cohort_phone p ON p.phone = i.phone
    LEFT JOIN cohort_address_phone b ON b.address = i.address AND b.phone = i.phone)"""
_GRAPH_EVENTS = f"""{_EX}, gev0 AS (
  SELECT entity_id, source_id, provider_type AS exclusion_type, coalesce(source_record_id, medicaid_provider_id, '') AS record,
         CASE WHEN starts_with(source_id, 'hawaii_medquest') THEN 'state_medicaid' WHEN starts_with(source_id, 'hawaii_dcca') THEN 'state_license'
              WHEN starts_with(source_id, 'sam_gov') THEN 'sam_gov' ELSE 'hhs_oig' END AS authority,
         {_DATE('exclusion_date')} AS excluded_at, {_DATE('reinstatement_date')} AS reinstated_at,
         coalesce(indefinite_exclusion, false) AS indefinite, nullif(upper(trim(ex.state)), '') AS state
  FROM (SELECT *, CASE WHEN {_NPI_OK} THEN trim(npi) END AS good FROM ex) ex
  JOIN member m ON m.name = ex.person_or_entity_name AND m.npi IS NOT DISTINCT FROM ex.good AND m.state IS NOT DISTINCT FROM upper(trim(ex.state)) JOIN member_ids USING (cluster)),
gev AS (SELECT *, CASE WHEN indefinite THEN 'indefinite' WHEN reinstated_at IS NOT NULL THEN 'reinstated' ELSE 'active' END AS status,
               substr(sha256(concat_ws('|', entity_id, authority, coalesce(strftime(excluded_at, '%Y-%m-%dT%H:%M:%S'), ''), record)), 1, 32) AS event_id
        FROM gev0 WHERE excluded_at IS NOT NULL OR reinstated_at IS NOT NULL)"""
_CANDIDATES = f"""candidate AS (SELECT entity_a, entity_b, confidence, signals FROM (
    SELECT least(x.entity_id, y.entity_id) AS entity_a, greatest(x.entity_id, y.entity_id) AS entity_b, round(s, 4) AS confidence, {_FIRED} AS signals,
           row_number() OVER (PARTITION BY least(x.entity_id, y.entity_id), greatest(x.entity_id, y.entity_id) ORDER BY round(s, 4) DESC, i, j) AS rn
    FROM scored JOIN member a ON a.idx = i JOIN member b ON b.idx = j JOIN member_ids x ON x.cluster = a.cluster JOIN member_ids y ON y.cluster = b.cluster
    WHERE s < 0.9 AND x.entity_id <> y.entity_id) c
  WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM last l WHERE l.entity_a = c.entity_a AND l.entity_b = c.entity_b AND verdict = 'reject'))"""
_CALIBRATION = f"""{_LAST}, fired AS (SELECT DISTINCT a, b, t FROM (SELECT least(entity_a, entity_b) AS a, greatest(entity_a, entity_b) AS b, unnest(signals) AS t FROM link_candidates WHERE entity_a <> entity_b)),
  cal AS (SELECT t AS signal_type, count(*) FILTER (verdict = 'confirm') AS n_true, count(*) FILTER (verdict = 'reject') AS n_false,
      round(count(*) FILTER (verdict = 'confirm')::DOUBLE / nullif(count(*) FILTER (verdict IN ('confirm', 'reject')), 0), 6) AS precision
    FROM fired JOIN last ON entity_a = a AND entity_b = b GROUP BY 1)"""
_SCORE_DATE = "[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}"

SQL = {
    "normalize_names": f"""WITH {_ENT} SELECT entity_id, norm, CASE WHEN list_has_any(string_split(norm, ' '), [{_ORG}]) THEN 'organization' ELSE 'individual' END AS kind
        FROM (SELECT entity_id, {_NORM('canonical_name')} AS norm FROM ent WHERE canonical_name IS NOT NULL)""",
    "phonetic_key_counts": f"""WITH {_ENT}, words AS (SELECT entity_id, unnest(string_split({_NORM('canonical_name')}, ' ')) AS w FROM ent WHERE canonical_name IS NOT NULL), {_PHONETIC}
        SELECT key AS phonetic_key, count(DISTINCT entity_id) AS n FROM keys WHERE length(w) > 1 GROUP BY 1""",
    "name_pair_scores": f"""WITH {_PAIRS} SELECT i, j, round(s, 4) AS score, {_FIRED} AS signals FROM scored""",
    "resolved_clusters": f"WITH RECURSIVE {_PAIRS}, {_BASE} SELECT cluster, count(*) AS n_records FROM base GROUP BY 1",
    "graph_entities": f"""WITH RECURSIVE {_GRAPH}, {_ENTITY} SELECT * FROM entity""",
    "graph_events": f"""WITH RECURSIVE {_GRAPH}, {_GRAPH_EVENTS}
        SELECT event_id, entity_id, authority, exclusion_type, strftime(excluded_at, '%Y-%m-%d %H:%M:%S') AS excluded_at,
               strftime(reinstated_at, '%Y-%m-%d %H:%M:%S') AS reinstated_at, status, state, source_id FROM gev""",
    "graph_candidates": f"""WITH RECURSIVE {_GRAPH}, {_CANDIDATES} SELECT * FROM candidate""",
    "graph_meta": f"""WITH RECURSIVE {_GRAPH}, {_GRAPH_EVENTS}, {_CANDIDATES}
        SELECT (SELECT count(*) FROM member) AS party_count, (SELECT count(*) - count(DISTINCT cluster) FROM member) AS merge_count,
               (SELECT count(DISTINCT cluster) FROM member) AS entity_count,
               (SELECT string_agg(DISTINCT state, ',' ORDER BY state) FROM (SELECT state FROM member WHERE trim(state) <> '' GROUP BY cluster, state QUALIFY {_TOP('state')})) AS jurisdiction_coverage,
               (SELECT count(*) FROM gev) AS exclusion_event_count, (SELECT count(*) FROM candidate) AS candidate_count,
               (SELECT string_agg(DISTINCT source_id, ',' ORDER BY source_id) FROM exclusions WHERE trim(person_or_entity_name) <> '') AS sources_ingested""",
    "confirmed_clusters": f"WITH RECURSIVE {_GRAPH} SELECT cluster, count(*) AS n_parties, sum(n)::BIGINT AS n_rows FROM member GROUP BY 1",
    "cohorts_address": f"WITH {_REG}, {_EXCLUDED}, {_COHORT('address')} SELECT * FROM cohort_address",
    "cohorts_phone": f"WITH {_REG}, {_EXCLUDED}, {_COHORT('phone')} SELECT * FROM cohort_phone",
    "cohorts_both": f"WITH {_REG}, {_EXCLUDED}, {_COHORT('address', 'phone')} SELECT * FROM cohort_address_phone",
    "best_candidates": f"WITH {_BEST} SELECT * FROM best",
    "latest_verdicts": f"WITH {_LAST} SELECT entity_a, entity_b, log_pos, verdict FROM last",
    "rejected_removed": f"WITH {_BEST}, {_LAST} SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.entity_a = b.entity_a AND l.entity_b = b.entity_b AND verdict = 'reject')",
    "review_queue": f"""WITH {_ENT}, {_BEST} SELECT b.entity_a, b.entity_b, coalesce(x.canonical_name, '') AS name_a, coalesce(y.canonical_name, '') AS name_b, confidence
        FROM best b LEFT JOIN ent x ON x.entity_id = b.entity_a LEFT JOIN ent y ON y.entity_id = b.entity_b
        WHERE upper(x.canonical_state) = 'HI' OR upper(y.canonical_state) = 'HI'""",
    "top_candidates": f"WITH {_BEST} SELECT * FROM best ORDER BY confidence DESC NULLS LAST, entity_a, entity_b LIMIT 10",
    "modal_names": """SELECT npi, name FROM (SELECT npi, name, row_number() OVER (PARTITION BY npi ORDER BY n DESC, strlen(name) DESC, name) AS rn FROM (
          SELECT npi, person_or_entity_name AS name, count(*) AS n FROM (SELECT DISTINCT * FROM exclusions) WHERE npi IS NOT NULL AND trim(person_or_entity_name) <> '' GROUP BY 1, 2)) WHERE rn = 1""",
    "event_status_counts": f"WITH {_EVENTS} SELECT authority, status, count(*) AS n, count(excluded_at) AS n_excluded, count(reinstated_at) AS n_reinstated FROM ev GROUP BY 1, 2",
    "event_profiles": f"WITH {_PROFILE} SELECT * FROM prof",
    "multi_tier_entities": f"WITH {_PROFILE} SELECT entity_id, tiers FROM prof WHERE contains(tiers, ',')",
    "entity_rollup": f"""WITH {_EX} SELECT {_PARTY} AS party, count(*) AS n_rows, string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS sources,
        count(DISTINCT upper(trim(state))) AS n_states, min(arrived_at) AS first_arrival, max(arrived_at) AS last_arrival FROM ex GROUP BY 1""",
    "entity_event_counts": f"""WITH {_ENT}, {_EVENTS}, c AS (SELECT entity_id, count(*) AS n, count(*) FILTER (status = 'active') AS a FROM ev GROUP BY 1)
        SELECT entity_id, coalesce(n, 0) AS n_events, coalesce(a, 0) AS n_active FROM ent LEFT JOIN c USING (entity_id)""",
    "event_spans": f"WITH {_EVENTS} SELECT entity_id, strftime(min(excluded_at), '%Y-%m-%d') AS first_excluded, strftime(max(excluded_at), '%Y-%m-%d') AS last_excluded FROM ev GROUP BY 1",
    "excluded_registry_rows": f"""WITH {_ENT}, pairs AS (SELECT entity_id, unnest(npis) AS npi, npi_active FROM ent)
        SELECT entity_id, npi, npi_active FROM pairs WHERE npi IN (SELECT trim(npi) FROM exclusions WHERE npi IS NOT NULL)""",
    "unmatched_exclusions": """SELECT DISTINCT row_id, trim(npi) AS npi FROM exclusions WHERE npi IS NOT NULL AND trim(npi) NOT IN (SELECT n FROM (SELECT unnest(npis) AS n FROM entities) WHERE n IS NOT NULL)""",
    "phone_cohorts": f"""WITH {_ENT}, p AS (SELECT entity_id, {_PHONE(c='practice_phone')} AS phone FROM ent WHERE npi_active)
        SELECT phone, count(*) AS n, array_to_string(list_slice(list_sort(list(entity_id)), 1, 10), ',') AS first_ids FROM p WHERE phone IS NOT NULL GROUP BY 1""",
    "shared_locations": f"""WITH {_ENT}, r AS (SELECT entity_id, upper(practice_address) AS a, {_PHONE(c='practice_phone')} AS p FROM ent)
        SELECT x.entity_id, count(DISTINCT y.entity_id) AS n_colocated, bool_or(coalesce(x.p = y.p, false)) AS phone_shared
        FROM r x JOIN r y ON x.entity_id <> y.entity_id AND (x.a = y.a OR x.p = y.p) GROUP BY 1""",
    "owner_correlation": f"""WITH {_ENT}, l AS (SELECT entity_id, canonical_name, entity_type, upper(canonical_state) AS es, {_NORM('canonical_name')} AS norm FROM ent),
        r AS (SELECT {_NORM('owner_name')} AS norm, upper(owner_state) AS os, upper(owner_type) AS ot, provider_org_name AS org FROM (SELECT DISTINCT * FROM owners))
        SELECT entity_id, canonical_name, entity_type, count(*) AS owned_rows, bool_or(coalesce(os = es, false)) AS state_agrees, count(DISTINCT org) AS n_orgs,
               coalesce(array_to_string(list_slice(list_sort(list(DISTINCT org) FILTER (org IS NOT NULL)), 1, 12), '|'), '') AS org_sample
        FROM l JOIN r ON l.norm = r.norm AND l.norm <> '' AND coalesce(os = es, true)
          AND coalesce(ot = CASE entity_type WHEN 'individual' THEN 'I' WHEN 'organization' THEN 'O' END, true) GROUP BY 1, 2, 3""",
    "verdict_calibration": f"""WITH {_LAST} SELECT reviewer, count(*) FILTER (verdict = 'confirm') AS n_confirm, count(*) FILTER (verdict = 'reject') AS n_reject,
        round(count(*) FILTER (verdict = 'confirm')::DOUBLE / nullif(count(*) FILTER (verdict IN ('confirm', 'reject')), 0), 6) AS precision FROM last GROUP BY 1""",
    "rejection_runs": """WITH log AS (SELECT DISTINCT reviewer, log_pos, coalesce(lower(trim(decision)) = 'reject', false) AS bad FROM decisions WHERE reviewer IS NOT NULL),
        marked AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY reviewer ORDER BY log_pos) AS island FROM log)
        SELECT reviewer, max(n) AS longest_run FROM (SELECT reviewer, island, count(*) AS n FROM marked WHERE bad GROUP BY 1, 2) GROUP BY 1""",
    "run_changes": f"SELECT from_run, to_run, change_kind, count(*) AS n FROM ({GENERAL_SQL['p2_found']}) GROUP BY 1, 2, 3",
    "run_totals": """SELECT run_no, reason_code, count(*) AS n_lines, count(DISTINCT signal_type) AS n_types, count(*) FILTER (confidence >= 0.7::DOUBLE) AS n_high FROM signal_rows GROUP BY 1, 2""",
    "address_keys": """SELECT claim_id, nullif(trim(regexp_replace(regexp_replace(upper(concat_ws(' ', coalesce(address_1, ''), coalesce(city, ''), coalesce(state, ''),
        substr(regexp_replace(coalesce(zip_code, ''), '[^0-9]', '', 'g'), 1, 5))), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), '') AS address_key FROM (SELECT DISTINCT * FROM address_claims)""",
    "phone_keys": f"WITH {_ENT} SELECT entity_id, {_PHONE(c='practice_phone')} AS phone FROM ent",
    "normalized_dates": f"""SELECT * FROM (SELECT row_id, strftime({_DATE('exclusion_date')}, '%Y-%m-%d') AS day FROM (SELECT DISTINCT row_id, exclusion_date FROM exclusions)) WHERE day IS NOT NULL""",
    "parse_quality": f"""WITH {_EX}, t AS (SELECT source_id, coalesce(person_or_entity_name, '') AS n, coalesce(exclusion_date, '') AS d FROM ex),
        s AS (SELECT source_id, round(greatest(0, 1 - (CASE WHEN length(n) < 2 THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(n, '{_SCORE_DATE}') THEN 0.3::DOUBLE ELSE 0 END
            + CASE WHEN d = '' THEN 0.3::DOUBLE WHEN NOT regexp_matches(d, '^{_SCORE_DATE}') THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN length(n) > 80 THEN 0.3::DOUBLE ELSE 0 END)), 6) AS score FROM t)
        SELECT source_id, count(*) AS n_rows, count(*) FILTER (score >= 0.7::DOUBLE) AS n_reliable, round(avg(score), 6) AS mean_score FROM s GROUP BY 1""",
    "text_fingerprints": f"""WITH p AS (SELECT doc_kind, len(string_split(text, chr(10))) AS l, len(regexp_extract_all(text, '{_SCORE_DATE}')) AS d FROM documents WHERE text IS NOT NULL)
        SELECT doc_kind, count(*) AS n_pages, sum(l)::BIGINT AS n_lines, round(avg(l), 6) AS lines_per_page, round(sum(d)::DOUBLE / sum(l), 6) AS dates_per_line FROM p GROUP BY 1""",
    "union_sources": f"""WITH {_EX} SELECT * EXCLUDE (arrived_at, observed_at) REPLACE (
        CASE WHEN NOT starts_with(source_id, 'hawaii') THEN npi END AS npi, CASE WHEN NOT starts_with(source_id, 'sam_gov') THEN state END AS state,
        CASE WHEN NOT starts_with(source_id, 'sam_gov') THEN medicaid_provider_id END AS medicaid_provider_id) FROM ex""",
    "source_statistics": f"""SELECT source_id, count(*) AS n_rows, count(*) FILTER ({_NPI_OK}) AS n_valid_npi, count(*) FILTER (indefinite_exclusion) AS n_indefinite,
        count(*) FILTER (coalesce(trim(person_or_entity_name), '') = '') AS n_nameless FROM exclusions GROUP BY 1""",
    "jurisdiction_entities": f"""WITH {_ENT}, k AS (
          SELECT trim(npi) AS key FROM exclusions WHERE upper(trim(state)) = 'HI' UNION SELECT 'name:' || {_NORM('person_or_entity_name')} FROM exclusions WHERE upper(trim(state)) = 'HI'),
        good AS (SELECT key FROM k WHERE key IS NOT NULL AND key <> 'name:')
        SELECT entity_id FROM ent WHERE coalesce(upper(canonical_state) = 'HI', false) OR coalesce(list_has_any(npis, (SELECT list(key) FROM good)), false)
          OR (starts_with(entity_id, 'name:') AND 'name:' || {_NORM('substr(entity_id, 6)')} IN (SELECT key FROM good))""",
    "signal_calibration": f"""WITH {_CALIBRATION} SELECT *, printf('%s: %d of %d confirmed', signal_type, n_true, n_true + n_false) AS line FROM cal""",
    "calibrated_candidates": f"""WITH {_CALIBRATION}, every AS (SELECT DISTINCT a, b, t FROM (
          SELECT least(entity_a, entity_b) AS a, greatest(entity_a, entity_b) AS b, unnest(CASE WHEN len(signals) > 0 THEN signals ELSE [NULL] END) AS t FROM link_candidates WHERE entity_a <> entity_b))
        SELECT a AS entity_a, b AS entity_b, count(t) AS n_signals, max(precision) AS best_precision FROM every LEFT JOIN cal ON signal_type = t GROUP BY 1, 2""",
    "provider_types": "SELECT provider_type, count(*) AS n_rows FROM owners WHERE provider_type IS NOT NULL GROUP BY 1",
    "first_edges": """SELECT provider_type, edge_id, owner_name FROM (SELECT *, row_number() OVER (PARTITION BY provider_type ORDER BY edge_id) AS rn
        FROM (SELECT DISTINCT provider_type, edge_id, owner_name FROM owners)) WHERE rn <= 3""",
    "name_hashes": f"""WITH {_ENT} SELECT entity_id, CASE WHEN canonical_name IS NOT NULL THEN list_reduce(list_prepend(2166136261::BIGINT,
        list_transform(list_filter(string_split({_NORM('canonical_name')}, ''), lambda c: c <> ''), lambda c: ord(c)::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295) END AS hash FROM ent""",
    "embedded_numbers": r"""SELECT DISTINCT * FROM (SELECT record_id, nullif(regexp_extract(raw_line, '\b[0-9]{10}\b'), '') AS number FROM raw_records) WHERE number IS NOT NULL""",
    "text_line_counts": r"""SELECT doc_id, len(l) AS n_lines, list_sum(list_transform(l, lambda x: length(x)))::BIGINT AS n_chars FROM (
          SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '<[^>]+>', chr(10), 'g'), '[\r\n]+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l
          FROM documents) WHERE len(l) > 0""",
    "header_shares": """SELECT doc_kind, count(*) AS n_pages, count(*) FILTER (contains(text, 'Case')) AS n_with_header, round(count(*) FILTER (contains(text, 'Case'))::DOUBLE / count(*), 6) AS header_share
        FROM documents WHERE text IS NOT NULL GROUP BY 1""",
    "unseen_signals": """WITH s AS (SELECT DISTINCT run_no, signal_id FROM signal_rows WHERE coalesce(signal_id, '') <> '' AND run_no IS NOT NULL), m AS (SELECT max(run_no) AS last FROM s)
        SELECT signal_id FROM s, m WHERE run_no = last AND signal_id NOT IN (SELECT signal_id FROM s, m WHERE run_no < last)""",
    "licence_round_trip": rf"""WITH {_EX}, line AS (
          SELECT row_id, trim(regexp_replace('BOARD OF ' || upper(coalesce(provider_type, '')) || ' MEDICINE', '\s+', ' ', 'g')) AS board,
                 upper(trim(regexp_replace(trim(regexp_replace(person_or_entity_name, '\s+', ' ', 'g')), '(?i)\b(fka|aka|dba|nka)\b.*$', ''))) AS person_or_entity_name,
                 'C-' || row_id AS source_record_id, CASE WHEN indefinite_exclusion THEN 'License revoked' WHEN indefinite_exclusion IS NULL THEN 'Fine' ELSE 'Suspension' END AS sanction,
                 CASE WHEN row_id % 100 >= 70 THEN 1900 ELSE 2000 END + row_id % 100 AS y FROM ex WHERE trim(person_or_entity_name) <> ''),
        kept AS (SELECT *, y || '-03-04T00:00:00+00:00' AS exclusion_date FROM line WHERE sanction <> 'Fine' AND person_or_entity_name <> ''
                 AND regexp_matches(board, '(?i){HEALTH_BOARDS}') AND NOT regexp_matches(board, '(?i)VETERINARY'))
        SELECT person_or_entity_name, exclusion_date, source_record_id, substr(concat_ws(' — ', board, sanction), 1, 200) AS provider_type, sanction = 'License revoked' AS indefinite_exclusion
        FROM kept QUALIFY row_number() OVER (PARTITION BY person_or_entity_name, exclusion_date ORDER BY row_id) = 1""",
}
_SCORED = SQL["parse_quality"].split("SELECT source_id, count(*)")[0]
SQL |= {
    "ranked_owner_findings": f"SELECT entity_id, state_agrees, owned_rows::BIGINT AS owned_rows FROM ({SQL['owner_correlation']}) ORDER BY state_agrees DESC, owned_rows DESC, entity_id LIMIT 10",
    "uncorroborated_owners": f"SELECT entity_type, count(*) AS n, count(*) FILTER (NOT state_agrees) AS n_name_only FROM ({SQL['owner_correlation']}) GROUP BY 1",
    "parse_reports": f"""{_SCORED}SELECT *, confidence >= 0.8::DOUBLE AND NOT drifted AS trustworthy FROM (SELECT *, n_records NOT BETWEEN 100 AND 100000 AS drifted,
        round(n_reliable::DOUBLE / n_records * CASE WHEN n_records NOT BETWEEN 100 AND 100000 THEN 0.7::DOUBLE ELSE 1 END, 6) AS confidence
        FROM (SELECT source_id, count(*) AS n_records, count(*) FILTER (score >= 0.7::DOUBLE) AS n_reliable FROM s GROUP BY 1))""",
}
