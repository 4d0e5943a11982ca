"""Typed JSON lines: reading strictly or leniently, splitting a graph by kind, writing tagged lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriplane.runtime import exists

ENTITY = (
    "entity_id string, entity_type string, canonical_name string, canonical_state string, npis array<string>, npi_active boolean, "
    "npi_deactivation_date string, practice_address string, practice_phone string, addr_cohort_active int, phone_cohort_active int, "
    "both_cohort_active int, colocated_sample array<string>, resolution_confidence double"
)
EVENT = (
    "event_id string, entity_id string, authority string, exclusion_type string, exclusion_date string, reinstatement_date string, "
    "status string, state string, source_id string, source_record_id string, source_snapshot_hash string, observed_at string"
)
LINK = "entity_a string, entity_b string, confidence double, signals array<string>"
META = "export_version string, exported_at string, pipeline_version string, entity_count long, exclusion_event_count long, sources_ingested array<string>, jurisdiction_coverage array<string>"
EXCLUSION = (
    "person_or_entity_name string, npi string, state string, exclusion_date string, reinstatement_date string, source_id string, source_record_id string, "
    "medicaid_provider_id string, provider_type string, indefinite_exclusion boolean, source_snapshot_hash string, observed_at string"
)
# Names of the normalised exclusion files.
NORMALIZED = ["leie_normalized", "leie_supplements_normalized", "hawaii_medquest_exclusions", "sam_exclusions", "hawaii_dcca_license"]
KINDS = {"meta": META, "entity": ENTITY, "exclusion_event": EVENT, "identity_link_candidate": LINK}


def read_lines(spark: SparkSession, path: str | list[str], schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; a malformed one is an error (strict) or skipped. Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of JSON lines: malformed ones are skipped, a missing log is empty."""
    return read_lines(spark, path, schema, strict=False) if exists(spark, path) else spark.createDataFrame([], schema)


def read_run(spark: SparkSession, path: str, schema: str, key: str = "signal_id") -> DataFrame:
    """Lines of a run; malformed ones and those without the key are skipped."""
    return read_lines(spark, path, schema, strict=False).where(F.coalesce(F.col(key), F.lit("")) != "")


def read_exclusions(spark: SparkSession, folder: str, names: list[str] = NORMALIZED) -> DataFrame:
    """The normalised exclusion files that are there, put together; a malformed line is an error, blank names are left out."""
    paths = [p for p in (f"{folder}/{n}.ndjson" for n in names) if exists(spark, p)]
    if not paths:
        raise FileNotFoundError(f"no normalised exclusions in {folder}")
    return read_lines(spark, paths, EXCLUSION).where("trim(person_or_entity_name) <> ''").fillna({"indefinite_exclusion": False})


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a graph file by kind. Unknown kinds are ignored; a line without valid JSON, or with a body that does not fit its kind, is an error."""
    text = spark.read.text(path).where("trim(value) <> ''")
    parsed = text.select("value", F.from_json("value", "kind string", {"mode": "FAILFAST"}).alias("k"))
    out = {}
    for kind, schema in KINDS.items():
        rows = parsed.where(F.col("k.kind") == kind).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
        if kind == "entity":
            rows = rows.fillna({"resolution_confidence": 1.0})
        out[kind] = rows
    return out


def tagged(rows: DataFrame, kind: str) -> DataFrame:
    """One JSON text per row, the kind first."""
    return rows.select(F.to_json(F.struct(F.lit(kind).alias("kind"), *rows.columns)).alias("value"))


def write_sections(sections: list[tuple[str, DataFrame]], path: str) -> None:
    """Tables as tagged lines in one folder: the files in the order of their names hold the sections in the given order.

    Ranges are over section and a hash of the line, so a large section is spread over many files.
    """
    parts = [tagged(rows, kind).withColumn("section", F.lit(n)) for n, (kind, rows) in enumerate(sections)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    out.repartitionByRange("section", F.xxhash64("value")).sortWithinPartitions("section").select("value").write.text(path)


def write_graph(tables: dict[str, DataFrame], path: str) -> None:
    """All tables of a graph as tagged lines, meta first."""
    write_sections([(k, tables[k]) for k in KINDS if k in tables], path)


def write_run(name: str, rows: DataFrame, path: str, totals: dict[str, Column]) -> None:
    """A run of findings: a line with its totals, then the rows."""
    write_sections([("meta", rows.agg(*[c.alias(k) for k, c in totals.items()])), (name, rows)], path)


def run_name(what: str, scope: str | None, at_ms: int) -> str:
    """Default name of a run: what it holds, its scope and the time in milliseconds."""
    return f"{what}_{(scope or 'all').lower()}_{at_ms}"
