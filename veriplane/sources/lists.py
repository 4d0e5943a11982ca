"""Raw exclusion, registry and ownership files to normalised rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriplane.functions.keys import address_key, blank_null, first_npi, phone_key

# Column order of the exclusion list with a header.
LIST_COLUMNS = (
    "LASTNAME FIRSTNAME MIDNAME BUSNAME GENERAL SPECIALTY UPIN NPI DOB ADDRESS CITY STATE ZIP EXCLTYPE EXCLDATE REINDATE WAIVERDATE WAIVERSTATE"
).split()
# 0-based positions in the headerless layouts.
REGISTRY_AT = {
    "npi": 0, "entity_type": 1, "org": 4, "last": 5, "first": 6, "line1": 28, "city": 30, "state": 31, "postal": 32, "phone": 34,
    "enumeration_date": 36, "last_update": 37, "deactivation_reason": 38, "deactivation_date": 39, "reactivation_date": 40,
}
EXTRACT_AT = {
    "classification": 0, "name": 1, "first": 3, "middle": 4, "last": 6, "state": 12, "agency": 17, "type": 19, "active_date": 21,
    "termination_date": 22, "number": 25, "npi": 27,
}
OWNER_AT = {
    "enrollment": 0, "pac": 1, "org": 2, "owner_pac": 3, "owner_type": 4, "role": 6, "first": 8, "middle": 9, "last": 10, "owner_org": 12,
    "state": 17, "pct": 19,
}


def positional(spark: SparkSession, path: str | list[str], width: int, header: bool = True, breaks_in_quotes: bool = False) -> DataFrame:
    """CSV files by position: columns _c0 ... of text, with the RFC 4180 quote rule; the header line is skipped.

    A file is split among tasks at line ends. Only where cells may hold line ends (``breaks_in_quotes``) is each file read by one task.
    """
    schema = ", ".join(f"_c{i} string" for i in range(width))
    return spark.read.schema(schema).options(header=header, escape='"', multiLine=breaks_in_quotes, enforceSchema=True, ignoreLeadingWhiteSpace=False).csv(path)


def numbered(rows: DataFrame, ordinal: str = "ordinal", file: str = "file") -> DataFrame:
    """``rows``, straight from files, with the path of their file and their 0-based place in it.

    Rows follow one another within a block of a file, so counts per block give the places: no global sort, no row
    leaves the JVM, and the shuffled table has one row per block.
    """
    placed = rows.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_place"))
    blocks = placed.groupBy(file, "_block").agg(F.count("*").alias("n"), F.min("_place").alias("_first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(file).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select(file, "_block", (before - F.col("_first")).alias("_shift"))
    return placed.join(starts, [file, "_block"]).withColumn(ordinal, F.col("_place") + F.col("_shift")).drop("_block", "_place", "_shift")


def _cell(at: dict[str, int], name: str):
    return F.coalesce(F.trim(F.col(f"_c{at[name]}")), F.lit(""))


def _last_first(last, *first):
    """``LAST, FIRST MIDDLE`` of the parts that are there, upper case."""
    given = F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in first])
    return F.upper(F.btrim(F.concat(last, F.lit(", "), given), F.lit(", ")))


def exclusion_list(spark: SparkSession, path: str | list[str], source_id: str, hashes: DataFrame | None = None) -> DataFrame:
    """Lists with a header, put together; the record id is the row's ordinal in its file, counting every row of it.

    With ``hashes``, a ``file_manifest`` of the files, each row carries the SHA-256 of its file.
    """
    read = spark.read.schema(", ".join(f"{c} string" for c in LIST_COLUMNS)).options(header=True, escape='"').csv(path)
    rows = numbered(read)
    if hashes is not None:
        rows = rows.join(hashes.select(F.col("path").alias("file"), F.col("sha256").alias("hash")), "file", "left")
    return exclusion_rows(rows, source_id, F.col("ordinal"), F.col("hash") if hashes is not None else F.lit(None).cast("string"))


def exclusion_rows(rows: DataFrame, source_id: str, ordinal: Column, snapshot: Column | None = None) -> DataFrame:
    """Rows with the columns of the list: zero numbers and dates are null, invalid dates too; rows without a name are left out."""
    day = lambda c: F.try_to_timestamp(F.nullif(F.trim(c), F.lit("00000000")), F.lit("yyyyMMdd"))
    name = F.coalesce(blank_null(F.col("BUSNAME")), F.concat_ws(" ", *[blank_null(F.col(c)) for c in ("LASTNAME", "FIRSTNAME", "MIDNAME")]))
    return rows.select(
        name.alias("person_or_entity_name"), F.nullif(blank_null(F.col("NPI")), F.lit("0000000000")).alias("npi"), blank_null(F.col("STATE")).alias("state"),
        day("EXCLDATE").alias("exclusion_date"), day("REINDATE").alias("reinstatement_date"), F.lit(source_id).alias("source_id"),
        ordinal.cast("string").alias("source_record_id"), blank_null(F.col("GENERAL")).alias("provider_type"),
        (F.lit(None).cast("string") if snapshot is None else snapshot).alias("source_snapshot_hash"),
    ).where("person_or_entity_name <> ''")


def registry(rows: DataFrame, source_id: str) -> DataFrame:
    """Registry rows by position: a reactivation date makes a provider active again, else a deactivation date ends it."""
    c = lambda n: _cell(REGISTRY_AT, n)
    name = F.when(c("entity_type") == "2", c("org")).otherwise(F.btrim(F.concat(c("last"), F.lit(", "), c("first")), F.lit(", ")))
    status = F.when(c("reactivation_date") != "", "ACTIVE").when(c("deactivation_date") != "", "DEACTIVATED").otherwise("ACTIVE")
    kept = ["enumeration_date", "last_update", "deactivation_reason", "deactivation_date", "reactivation_date"]
    return rows.where(c("npi").rlike("^[0-9]{10}$")).select(
        c("npi").alias("npi"), status.alias("status"), F.coalesce(F.when(c("entity_type").rlike("^[0-9]+$"), c("entity_type")).try_cast("int"), F.lit(1)).alias("entity_type"),
        F.nullif(name, F.lit("")).alias("name"), F.nullif(c("state"), F.lit("")).alias("state"),
        address_key(c("line1"), c("city"), c("state"), c("postal")).alias("address"), phone_key(c("phone")).alias("phone"),
        *[F.nullif(c(k), F.lit("")).alias(k) for k in kept], F.lit(source_id).alias("source_id"),
    )


def federal_extract(rows: DataFrame, source_id: str) -> DataFrame:
    """Extract rows that carry a provider number; rows of column titles are left out. The record id is the extract's own number."""
    c = lambda n: _cell(EXTRACT_AT, n)
    name = F.when(F.lower(c("classification")) == "individual", _last_first(c("last"), c("first"), c("middle"))).otherwise(F.upper(c("name")))
    basis = F.nullif(F.concat_ws(" — ", F.nullif(c("type"), F.lit("")), F.nullif(c("agency"), F.lit(""))), F.lit(""))
    ended = F.when(c("termination_date").rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), c("termination_date"))
    return rows.where((F.lower(c("classification")) != "classification") & first_npi(c("npi")).isNotNull() & (name != "")).select(
        name.alias("person_or_entity_name"), first_npi(c("npi")).alias("npi"), F.nullif(F.upper(c("state")), F.lit("")).alias("state"),
        F.nullif(c("active_date"), F.lit("")).alias("exclusion_date"), ended.alias("reinstatement_date"),
        (F.lower(c("termination_date")) == "indefinite").alias("indefinite_exclusion"), basis.alias("provider_type"), F.lit(source_id).alias("source_id"),
        F.nullif(c("number"), F.lit("")).alias("source_record_id"),
    )


def ownership(rows: DataFrame, provider_type: str, source_id: str) -> DataFrame:
    """Ownership rows with an owner; the share is a plain decimal number or null."""
    c = lambda n: _cell(OWNER_AT, n)
    name = F.when(c("owner_type") == "I", _last_first(c("last"), c("first"), c("middle"))).otherwise(F.upper(c("owner_org")))
    share = F.when(c("pct").rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), c("pct")).try_cast("double")
    null = lambda n: F.nullif(c(n), F.lit(""))
    return rows.where(name != "").select(
        null("org").alias("provider_org_name"), null("pac").alias("provider_pac_id"), null("enrollment").alias("provider_enrollment_id"), F.lit(provider_type).alias("provider_type"),
        null("owner_type").alias("owner_type"), name.alias("owner_name"), null("state").alias("owner_state"), null("role").alias("owner_role"),
        share.alias("ownership_pct"), null("owner_pac").alias("owner_pac_id"), F.lit(source_id).alias("source_id"),
    )


def ownership_files(spark: SparkSession, paths: dict[str, str], width: int, source_id: str) -> DataFrame:
    """The ownership files of several provider types (type -> path), put together in the order of the types."""
    parts = [ownership(positional(spark, path, width), kind, source_id) for kind, path in sorted(paths.items())]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def first_rows(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each key, as a ranked limit: every map task sends ``n`` rows of a key at most."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
