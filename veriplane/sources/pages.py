"""Licence pages: HTML to lines, lines to labelled records."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriplane.functions.keys import rfc3339_or_us_date

# Labels of a record and their fields; boards and sanctions of interest.
LABELS = {"respondent:": "name", "case number:": "case", "sanction:": "sanction", "effective date:": "date"}
NOT_HEADINGS = "RESPONDENT|CASE|SANCTION|EFFECTIVE|RICO"
HEALTH_BOARDS = (
    "NURSING|MEDICAL|MEDICINE|PHARMAC|DENTAL|DENTIST|PSYCHOLOG|SOCIAL WORK|OSTEOPATH|CHIROPRACT|OPTOMETR|ACUPUNCT|NATUROPATH|SPEECH"
    "|PHYSICAL THERAP|OCCUPATIONAL THERAP|MARRIAGE|MENTAL HEALTH|COUNSEL|MIDWIF|RESPIRATORY|NURSING HOME|CARE"
)
SERIOUS = "revoc|revoke|suspen|surrender|relinquish|forfeit|barred|denial|denied|voluntar"


@F.pandas_udf(T.StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """Character references to characters; no built-in expression knows them all."""
    return texts.map(html.unescape, na_action="ignore")


def text_lines(pages: DataFrame, key: str, body: str) -> DataFrame:
    """``(<key>, pos, line)``: the non-blank lines of each page without tags."""
    bare = F.regexp_replace(F.regexp_replace(F.col(body), "(?is)<(script|style)[^>]*>.*?</\\1>", " "), "<[^>]+>", "\n")
    lines = F.posexplode(F.split(unescape(bare), r"[\r\n]+"))
    return pages.select(key, lines.alias("pos", "line")).select(key, "pos", F.trim(F.regexp_replace("line", r"\s+", " ")).alias("line")).where("line <> ''")


def licence_records(lines: DataFrame, key: str) -> DataFrame:
    """Serious actions of health boards: (<key>, record, name, board, case, sanction, date), one per respondent.

    The nearest all-caps heading above is the board; a label's value stands behind it or on the next line.
    """
    order = Window.partitionBy(key).orderBy("pos")
    line, low = F.col("line"), F.lower("line")
    heading = (line == F.upper(line)) & ~line.rlike(f"^({NOT_HEADINGS})") & (F.length(line) >= 6) & (F.regexp_count(line, F.lit("[A-Z]{2,}")) >= 2)
    label = F.lit(None).cast("string")
    for text, field in LABELS.items():
        label = F.when(low.startswith(text), field).otherwise(label)
    marked = lines.withColumns({"heading": heading, "label": label})
    marked = marked.withColumns({"next": F.lead("line").over(order), "plain_next": F.lead(F.col("label").isNull() & ~F.col("heading")).over(order)})
    inline = F.trim(F.substring_index(line, ":", -1))
    inline = F.when(F.instr(line, ":") > 0, F.trim(F.expr("substring(line, instr(line, ':') + 1)"))).otherwise(inline)
    value = F.when((inline == "") & F.coalesce("plain_next", F.lit(False)), F.col("next")).otherwise(inline)
    marked = marked.withColumns(
        {
            "value": F.when(F.col("label").isNotNull(), value),
            "board": F.last(F.when(F.col("heading"), line), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "record": F.sum(F.when(F.col("label") == "name", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    pick = lambda field: F.max_by(F.when(F.col("label") == field, F.col("value")), F.when(F.col("label") == field, F.col("pos")))
    records = marked.where("record > 0 and label is not null").groupBy(key, "record").agg(
        pick("name").alias("name"), F.first(F.when(F.col("label") == "name", F.col("board")), ignorenulls=True).alias("board"),
        pick("case").alias("case"), pick("sanction").alias("sanction"), pick("date").alias("date"),
    )
    health = F.col("board").rlike(f"(?i){HEALTH_BOARDS}") & ~F.col("board").rlike("(?i)VETERINARY")
    name = F.upper(F.trim(F.element_at(F.split("name", r"(?i)\b(?:fka|aka|dba|nka)\b"), 1)))
    return records.where(health & F.coalesce(F.col("sanction").rlike(f"(?i){SERIOUS}"), F.lit(False))).select(key, "record", name.alias("name"), "board", "case", "sanction", "date").where("name <> ''")


def licence_exclusions(records: DataFrame, key: str, source_id: str, state: str, snapshot: str = "") -> DataFrame:
    """Licence actions in the common exclusion schema; of rows of one name and date the first page's counts.

    The date is the first d-d-yy or d-d-yyyy token (dashes or slashes; two digits mean 1970-2069); a
    revocation is indefinite.
    """
    token = F.translate(F.regexp_extract("date", r"[0-9]{1,2}[-/][0-9]{1,2}[-/](?:[0-9]{4}|[0-9]{2})", 0), "-", "/")
    rows = records.select(
        F.col("name").alias("person_or_entity_name"), F.lit(None).cast("string").alias("npi"), F.lit(state).alias("state"),
        F.date_format(rfc3339_or_us_date(token), "yyyy-MM-dd'T'00:00:00+00:00").alias("exclusion_date"), F.lit(None).cast("string").alias("reinstatement_date"),
        F.lit(source_id).alias("source_id"), F.nullif("case", F.lit("")).alias("source_record_id"), F.substring(F.concat_ws(" — ", "board", "sanction"), 1, 200).alias("provider_type"),
        F.col("sanction").rlike("(?i)revoc|revoke").alias("indefinite_exclusion"), F.lit(snapshot).alias("source_snapshot_hash"), F.col(key).alias("_page"), "record",
    )
    first = Window.partitionBy("person_or_entity_name", "exclusion_date").orderBy("_page", "record")
    return rows.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn", "_page", "record")
