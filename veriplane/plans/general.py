"""Queries of the general data-processing problems: p2, p5 and p7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriplane.operators.instants import normalize_instants
from veriplane.operators.rowparse import LEIE, OWNERS, REGISTRY, check_rows, split_rows
from veriplane.operators.snapshots import snapshot_changes
from veriplane.runtime import fresh_path, stored, table
from veriplane.sources.lists import LIST_COLUMNS, exclusion_rows, ownership, registry

LAYOUTS = [LEIE, REGISTRY, OWNERS]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_changes(table(spark, folder, "signal_rows"), "run_no", "signal_id", "line_no", ["reason_code"], {"confidence": 1e-9})


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    judged = check_rows(table(spark, folder, "raw_records"), "raw_line", "layout", LAYOUTS)
    return judged.where("reason is not null").select("record_id", "reason").distinct()


def _good(spark: SparkSession, folder: str) -> DataFrame:
    return split_rows(table(spark, folder, "raw_records").select("record_id", "file_name", "line_no", "layout", "raw_line").distinct(), "raw_line", "layout", LAYOUTS)[0]


def p5_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """The valid rows with all their fields, a unit separator between them."""
    return _good(spark, folder).select("record_id", "layout", F.size("fields").cast("long").alias("n_fields"), F.array_join("fields", "\x1f").alias("fields"))


def _cells(spark, folder, spec):
    """The valid rows of a layout by position."""
    rows = _good(spark, folder).where(F.col("layout") == spec.name)
    return rows.select("record_id", "file_name", "line_no", *[F.col("fields")[i].alias(f"_c{i}") for i in range(spec.width)])


def normalized_leie(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of exclusion lists in the common schema, numbered by their line."""
    cells = _cells(spark, folder, LEIE).select("line_no", *[F.col(f"_c{i}").alias(c) for i, c in enumerate(LIST_COLUMNS)])
    rows = exclusion_rows(cells, "leie_updates", F.col("line_no"))
    return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("exclusion_date", "reinstatement_date")}).drop("source_snapshot_hash")


def normalized_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of registry files as providers."""
    return registry(_cells(spark, folder, REGISTRY), "registry")


def normalized_owners(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of ownership files as edges."""
    return ownership(_cells(spark, folder, OWNERS), "unknown", "ownership_disclosure")


_STAMPS = ["exclusion_date", "reinstatement_date", "observed_at"]


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Instants through a dictionary that is kept: in the folder that spark.veriplane.dictionary names, from run to run; otherwise for this run."""
    kept = spark.conf.get("spark.veriplane.dictionary", None) or fresh_path(spark, "dictionary")
    return normalize_instants(table(spark, folder, "exclusions"), "row_id", _STAMPS, "source_id", table(spark, folder, "sources"), kept)


def p7_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """As p7_found, the rows delivered in two parts by year of arrival; the second part only parses texts that the first had not."""
    rows, sources, kept = table(spark, folder, "exclusions"), table(spark, folder, "sources"), fresh_path(spark, "dictionary")
    early = F.coalesce(F.year("arrived_at") < 2023, F.lit(True))
    parts = [stored(normalize_instants(rows.where(part), "row_id", _STAMPS, "source_id", sources, kept), "delivery") for part in (early, ~early)]
    return parts[0].unionByName(parts[1]).distinct()


QUERIES = {
    "p2_found": p2_found, "p5_found": p5_found, "p5_loaded": p5_loaded, "p7_found": p7_found, "p7_deliveries": p7_deliveries,
    "normalized_leie": normalized_leie, "normalized_registry": normalized_registry, "normalized_owners": normalized_owners,
}

_FIELD = r'(?:"(?:[^"]|"")*"|[^",\r\n]*)'

_JUDGED = rf"""
        texts AS (
          SELECT DISTINCT record_id, file_name, line_no, layout, regexp_replace(raw_line, '\r$', '') AS t FROM raw_records),
        shaped AS (
          SELECT *, regexp_full_match(t, '{_FIELD}(,{_FIELD})*') AS fits,
                 CASE layout WHEN 'leie' THEN 18 WHEN 'registry' THEN 51 ELSE 40 END AS width FROM texts),
        cut AS (
          SELECT *, list_transform(regexp_extract_all(',' || t, ',({_FIELD})', 1), lambda x:
                   CASE WHEN x LIKE '"%' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS f
          FROM shaped),
        named AS (
          SELECT *, trim(CASE layout WHEN 'leie' THEN f[8] WHEN 'registry' THEN f[1] END) AS npi, trim(f[20]) AS pct FROM cut),
        judged AS (
          SELECT record_id, line_no, layout, f, CASE
            WHEN NOT fits THEN 'quoting'
            WHEN len(f) <> width THEN 'column_count'
            WHEN layout <> 'owners' AND NOT (layout = 'leie' AND npi IN ('', '0000000000'))
             AND NOT (regexp_full_match(npi, '[0-9]{{10}}') AND (24 + list_sum(list_transform(generate_series(1, 10), lambda i:
                   CASE WHEN i % 2 = 1 THEN (2 * ord(substr(npi, i, 1)) - 96) // 10 + (2 * ord(substr(npi, i, 1)) - 96) % 10
                        ELSE ord(substr(npi, i, 1)) - 48 END))) % 10 = 0) THEN 'bad_npi'
            WHEN layout = 'leie' AND NOT (
                  (trim(f[15]) = '' OR f[15] = '00000000' OR (regexp_full_match(f[15], '[0-9]{{8}}') AND try_strptime(f[15], '%Y%m%d') IS NOT NULL))
              AND (trim(f[16]) = '' OR f[16] = '00000000' OR (regexp_full_match(f[16], '[0-9]{{8}}') AND try_strptime(f[16], '%Y%m%d') IS NOT NULL)))
              THEN 'bad_date'
            WHEN layout = 'owners' AND pct <> ''
             AND NOT (regexp_full_match(pct, '[0-9]+[.]?[0-9]*|[.][0-9]+') AND try_cast(pct AS DOUBLE) <= 100) THEN 'bad_pct' END AS reason
          FROM named)"""
_GOOD = f"{_JUDGED}, good AS (SELECT * FROM judged WHERE reason IS NULL)"
_OR_NULL = "nullif(trim({0}), '')".format
_DAY = "strftime(CASE WHEN trim({0}) NOT IN ('', '00000000') THEN try_strptime(trim({0}), '%Y%m%d') END, '%Y-%m-%d')".format

SQL = {
    "p2_found": """
        WITH runs AS (
          SELECT run_no, lead(run_no) OVER (ORDER BY run_no) AS next_run
          FROM (SELECT DISTINCT run_no FROM signal_rows WHERE run_no IS NOT NULL)),
        latest AS (
          SELECT run_no, signal_id, coalesce(reason_code, '') AS reason_code, confidence
          FROM (SELECT *, row_number() OVER (PARTITION BY run_no, signal_id ORDER BY line_no DESC) AS rn
                FROM signal_rows WHERE signal_id IS NOT NULL AND signal_id <> '' AND run_no IS NOT NULL)
          WHERE rn = 1),
        gone AS (
          SELECT r.run_no AS from_run, r.next_run AS to_run, a.signal_id,
                 CASE WHEN b.signal_id IS NULL THEN 'removed'
                      WHEN a.reason_code <> b.reason_code
                        OR (a.confidence IS NULL) <> (b.confidence IS NULL)
                        OR abs(a.confidence - b.confidence) > 1e-9 THEN 'changed' END AS change_kind
          FROM runs r JOIN latest a ON a.run_no = r.run_no
          LEFT JOIN latest b ON b.run_no = r.next_run AND b.signal_id = a.signal_id
          WHERE r.next_run IS NOT NULL),
        came AS (
          SELECT r.run_no AS from_run, r.next_run AS to_run, b.signal_id, 'added' AS change_kind
          FROM runs r JOIN latest b ON b.run_no = r.next_run
          LEFT JOIN latest a ON a.run_no = r.run_no AND a.signal_id = b.signal_id
          WHERE a.signal_id IS NULL)
        SELECT * FROM gone WHERE change_kind IS NOT NULL UNION ALL SELECT * FROM came""",
    "p5_found": f"""WITH {_JUDGED} SELECT record_id, reason FROM judged WHERE reason IS NOT NULL""",
    "p5_loaded": f"""WITH {_GOOD} SELECT record_id, layout, len(f) AS n_fields, array_to_string(f, chr(31)) AS fields FROM good""",
    "normalized_leie": f"""WITH {_GOOD} SELECT * FROM (SELECT
        coalesce({_OR_NULL('f[4]')}, concat_ws(' ', {_OR_NULL('f[1]')}, {_OR_NULL('f[2]')}, {_OR_NULL('f[3]')})) AS person_or_entity_name,
        nullif({_OR_NULL('f[8]')}, '0000000000') AS npi, {_OR_NULL('f[12]')} AS state, {_DAY('f[15]')} AS exclusion_date, {_DAY('f[16]')} AS reinstatement_date,
        'leie_updates' AS source_id, line_no::VARCHAR AS source_record_id, {_OR_NULL('f[5]')} AS provider_type
        FROM good WHERE layout = 'leie') WHERE person_or_entity_name <> ''""",
    "normalized_registry": f"""WITH {_GOOD} SELECT trim(f[1]) AS npi,
        CASE WHEN trim(f[41]) <> '' THEN 'ACTIVE' WHEN trim(f[40]) <> '' THEN 'DEACTIVATED' ELSE 'ACTIVE' END AS status,
        coalesce(CASE WHEN regexp_full_match(trim(f[2]), '[0-9]+') THEN try_cast(trim(f[2]) AS INTEGER) END, 1) AS entity_type,
        nullif(CASE WHEN trim(f[2]) = '2' THEN trim(f[5]) ELSE trim(trim(f[6]) || ', ' || trim(f[7]), ', ') END, '') AS name, {_OR_NULL('f[32]')} AS state,
        nullif(trim(regexp_replace(regexp_replace(upper(concat_ws(' ', trim(f[29]), trim(f[31]), trim(f[32]), substr(regexp_replace(f[33], '[^0-9]', '', 'g'), 1, 5))), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), '') AS address,
        CASE WHEN length(regexp_replace(f[35], '[^0-9]', '', 'g')) >= 10 THEN right(regexp_replace(f[35], '[^0-9]', '', 'g'), 10) END AS phone,
        {_OR_NULL('f[37]')} AS enumeration_date, {_OR_NULL('f[38]')} AS last_update, {_OR_NULL('f[39]')} AS deactivation_reason, {_OR_NULL('f[40]')} AS deactivation_date,
        {_OR_NULL('f[41]')} AS reactivation_date, 'registry' AS source_id FROM good WHERE layout = 'registry'""",
    "normalized_owners": f"""WITH {_GOOD} SELECT * FROM (SELECT
        {_OR_NULL('f[3]')} AS provider_org_name, {_OR_NULL('f[2]')} AS provider_pac_id, {_OR_NULL('f[1]')} AS provider_enrollment_id, 'unknown' AS provider_type, {_OR_NULL('f[5]')} AS owner_type,
        upper(CASE WHEN trim(f[5]) = 'I' THEN trim(trim(f[11]) || ', ' || concat_ws(' ', {_OR_NULL('f[9]')}, {_OR_NULL('f[10]')}), ', ') ELSE trim(f[13]) END) AS owner_name,
        {_OR_NULL('f[18]')} AS owner_state, {_OR_NULL('f[7]')} AS owner_role, try_cast({_OR_NULL('f[20]')} AS DOUBLE) AS ownership_pct, {_OR_NULL('f[4]')} AS owner_pac_id, 'ownership_disclosure' AS source_id
        FROM good WHERE layout = 'owners') WHERE owner_name <> ''""",
}
