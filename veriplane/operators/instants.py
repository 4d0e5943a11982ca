"""Mixed timestamp formats and time zones, normalised to UTC instants through a dictionary of distinct texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriplane.functions.codes import literal_map
from veriplane.runtime import exists, stored

# English month names by their first three letters.
MONTHS = {
    "jan": "1", "feb": "2", "mar": "3", "apr": "4", "may": "5", "jun": "6",
    "jul": "7", "aug": "8", "sep": "9", "oct": "10", "nov": "11", "dec": "12",
}

# Zone abbreviations and their offsets from UTC in minutes.
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0,
    "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "HDT": -540, "HAST": -600, "HADT": -540,
    "SST": -660, "CHST": 600,
}

_DAYS = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\.?,?\s+)?"
_MONTH = (
    r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
_TIME = r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]{1,9}))?)?\s*([ap]\.?m\.?)?"
_ZONE = r"(z|[a-z]{2,4}|(?:utc|gmt)?[+-][0-9]{1,2}(?::?[0-9]{2})?)?\s*(?:\[([a-z0-9_+/-]+)\])?"

#: What may follow a date: groups hour, minute, second, fraction, half of day, zone, region.
_CLOCK = rf"(?:(?:\s*t\s*|,?\s+(?:at\s+)?){_TIME}\s*{_ZONE})?"

# Patterns of a whole text, and the order of their groups as year|month|day|hour|minute|second|fraction|half|offset|region.
# "M" and "D" in an order are the numbers whose meaning the source decides.
_NUMERIC = rf"\A{_DAYS}([0-9]{{1,2}})([-/.])([0-9]{{1,2}})\2([0-9]{{4}}|[0-9]{{2}}){_CLOCK}\z"
_DAY_FIRST, _MONTH_FIRST = "$4|$3|$1|$5|$6|$7|$8|$9|$10|$11", "$4|$1|$3|$5|$6|$7|$8|$9|$10|$11"
#: Year, month and day without separators; year first; day before, and after, the name of the month.
_FORMS = [
    (
        r"\A([0-9]{4})([0-9]{2})([0-9]{2})(?:t([0-9]{2})([0-9]{2})(?:([0-9]{2})(?:[.,]([0-9]{1,9}))?)?\s*" + _ZONE + r")?\z",
        "$1|$2|$3|$4|$5|$6|$7||$8|$9",
    ),
    (rf"\A{_DAYS}([0-9]{{4}})([-/.])([0-9]{{1,2}})\2([0-9]{{1,2}}){_CLOCK}\z", "$1|$3|$4|$5|$6|$7|$8|$9|$10|$11"),
    (
        rf"\A{_DAYS}([0-9]{{1,2}})(?:st|nd|rd|th)?[-\s]+{_MONTH}\.?,?[-\s]+([0-9]{{4}}|[0-9]{{2}}){_CLOCK}\z",
        "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10",
    ),
    (
        rf"\A{_DAYS}{_MONTH}\.?[-\s]+([0-9]{{1,2}})(?:st|nd|rd|th)?,?[-\s]+([0-9]{{4}}|[0-9]{{2}}){_CLOCK}\z",
        "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10",
    ),
]


def known_zones(spark: SparkSession) -> list[str]:
    """The IANA zone ids this JVM can convert."""
    return sorted(spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())


def _int(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("int")


def parse_instants(texts: DataFrame, zones: list[str]) -> DataFrame:
    """``texts`` (raw, zone, day_first) with ``utc_us``: UTC microseconds, null where ``raw`` denotes no real date or instant.

    A date alone is midnight UTC. A time without zone is local to ``zone`` (unknown
    zone: no instant): of a doubled local hour the first pass is meant and a
    skipped local time moves forward by the gap. An offset wins over a bracketed
    region, a region over ``zone``. ``day_first`` orders numeric dates
    that don't begin with a year of four digits. Two-digit years lie in 1970-2069. Bare
    numbers of ten or thirteen digits are epoch seconds or milliseconds. Fractions finer
    than a microsecond are cut off. Hours run 0-23, or 1-12 with AM or PM, and
    24:00 ends its day; a 60th second does not exist.

    The first characters of a text tell which one form it can have, and only that pattern runs, once. Zones are
    looked up in a broadcast table of the few hundred ids that ``zones`` lists. The steps are separate projections.
    """
    spark = texts.sparkSession
    # as many rows as there are zones in the world
    ids = F.broadcast(spark.createDataFrame([(z.lower(), z) for z in zones], "_low string, _id string"))
    micros, minute_us, day_us = (F.lit(x).cast("long") for x in (1_000_000, 60_000_000, 86_400_000_000))
    text, mark = F.col("_text"), "\x01"
    got = texts.select("*", F.lower(F.btrim("raw", F.lit(" \t\n\x0b\f\r"))).alias("_text"))
    got = got.withColumn("_text", F.when(~F.contains(text, F.lit(mark)), text))
    cut = lambda pattern, order: F.regexp_replace(text, F.lit(pattern), F.lit(order.replace("|", mark)))
    numeric = F.when(F.col("day_first"), cut(_NUMERIC, _DAY_FIRST)).otherwise(cut(_NUMERIC, _MONTH_FIRST))
    compact, year_first, day_name, month_name = (cut(*form) for form in _FORMS)
    digits = F.length(text) - F.length(F.ltrim(text, F.lit("0123456789")))  # at the beginning
    worded = F.when(text.rlike(rf"\A{_DAYS}[0-9]{{4}}"), year_first).when(text.rlike(rf"\A{_DAYS}[0-9]{{1,2}}[-/.][0-9]"), numeric).when(text.rlike(rf"\A{_DAYS}[0-9]"), day_name).otherwise(month_name)
    form = (
        F.when(digits == 0, worded)
        .when(digits == 4, year_first)
        .when(digits == 8, compact)
        .when((digits <= 2) & F.substr(text, digits + 2, F.lit(1)).between("0", "9"), numeric)
        .when(digits <= 2, day_name)
    )
    got = got.withColumn("_form", form)
    got = got.select("*", F.split(F.when(F.contains("_form", F.lit(mark)), F.col("_form")), mark, -1).alias("_p"))
    part = lambda i: F.get("_p", i)
    offset = F.when(part(8) != "", F.upper(F.regexp_replace(part(8), r"\A(?:utc|gmt)(?=[+-])", ""))).otherwise(part(8))
    got = got.select(
        *texts.columns, "_text",
        part(0).alias("_y"),
        F.coalesce(F.try_element_at(literal_map(MONTHS), F.substring(part(1), 1, 3)), part(1)).try_cast("int").alias("_mo"),
        _int(part(2)).alias("_d"), _int(part(3)).alias("_h"), _int(part(4)).alias("_mi"),
        F.coalesce(_int(part(5)), F.lit(0)).alias("_s"),
        F.coalesce(_int(F.rpad(F.substring(part(6), 1, 6), 6, "0")), F.lit(0)).alias("_us"),
        F.substring(part(7), 1, 1).alias("_half"), offset.alias("_offset"), F.nullif(part(9), F.lit("")).alias("_region"),
    )
    place = F.coalesce("_region", F.lower("zone"))  # a bracketed region instead of the source's zone
    got = got.withColumn("_place", place).join(ids, F.col("_place") == F.col("_low"), "left").drop("_place", "_low").withColumnRenamed("_id", "_where")
    y = F.col("_y").try_cast("int")
    signed = F.substring("_offset", 1, 1).isin("+", "-")
    got = got.withColumns(
        {
            "_year": F.when(F.length("_y") == 2, y + F.when(y >= 70, 1900).otherwise(2000)).otherwise(y),
            "_hour": F.when(F.col("_half") == "", F.col("_h")).when(F.col("_h").between(1, 12), F.col("_h") % 12 + F.when(F.col("_half") == "p", 12).otherwise(0)),
            "_off_h": F.when(signed, F.regexp_extract("_offset", r"\A[+-]([0-9]{1,2}):?([0-9]{2})?\z", 1)).otherwise(""),
            "_off_m": F.coalesce(F.when(signed, _int(F.regexp_extract("_offset", r"\A[+-]([0-9]{1,2}):?([0-9]{2})?\z", 2))), F.lit(0)),
        }
    )
    year, month, day, hour = (F.col(c) for c in ("_year", "_mo", "_d", "_hour"))
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    length = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    real_date = (year >= 1) & month.between(1, 12) & (day >= 1) & (day <= length)
    whole_day = (F.col("_half") == "") & (hour == 24) & (F.col("_mi") == 0) & (F.col("_s") == 0)
    real_time = (hour.between(0, 23) | whole_day) & F.col("_mi").between(0, 59) & F.col("_s").between(0, 59)
    by_number = F.when((_int(F.col("_off_h")) <= 18) & (F.col("_off_m") <= 59), (_int(F.col("_off_h")) * 60 + F.col("_off_m")) * F.when(F.col("_offset").startswith("-"), -1).otherwise(1))
    by_name = F.try_element_at(F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair]), "_offset")
    got = got.withColumns(
        {
            "_day_us": F.when(real_date, F.unix_date(F.make_date(year, month, day)).cast("long")) * day_us,
            "_clock": F.when(real_time, (hour.cast("long") * 3600 + F.col("_mi") * 60 + F.col("_s")) * micros + F.col("_us")),
            "_minutes": F.when(F.col("_off_h") != "", by_number).otherwise(by_name),
        }
    ).withColumn("_local", F.col("_day_us") + F.col("_clock"))
    epoch = text.rlike(r"\A(?:[0-9]{10}|[0-9]{13})\z")
    since = F.when(epoch, text).try_cast("long") * F.when(F.length(text) == 10, micros).otherwise(F.lit(1000).cast("long"))
    shifted = F.when(
        F.col("_where").isNotNull() & F.col("_local").isNotNull(),
        F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("_local"), F.col("_where"))),
    )
    instant = (
        F.when(epoch, since)
        .when(F.col("_h").isNull(), F.col("_day_us"))
        .when(F.col("_offset") != "", F.col("_local") - F.col("_minutes").cast("long") * minute_us)
        .otherwise(shifted)
    )
    return got.select(*texts.columns, instant.alias("utc_us"))


def text_dictionary(texts: DataFrame, zones: list[str], known: DataFrame | None = None) -> DataFrame:
    """Dictionary ``(raw, zone, day_first, utc_us)`` of the distinct texts of ``texts``.

    ``texts`` has columns raw, zone, day_first. Each distinct value is parsed once.
    With ``known``, a dictionary kept from earlier runs, only the values it lacks are
    parsed; the result then holds the new ones alone, to be appended to it. Texts that
    denote nothing are kept with a null instant, lest they be parsed again.
    """
    keys = ["raw", "zone", "day_first"]
    distinct = texts.select(*keys).where("raw is not null").distinct()
    if known is not None:
        same = [distinct[k].eqNullSafe(known[k]) for k in keys]
        distinct = distinct.join(known.select(*keys), same, "left_anti")
    return parse_instants(distinct.select(*keys), zones)


def append_dictionary(texts: DataFrame, path: str) -> DataFrame:
    """Bring the dictionary kept at ``path`` up to date with ``texts`` and return it whole.

    Only values not yet in it are parsed and appended, so the cost of a delivery follows its
    new spellings. A run that was broken off may leave values twice; readers see each once.
    """
    spark = texts.sparkSession
    schema = "raw string, zone string, day_first boolean, utc_us long"
    known = spark.read.schema(schema).parquet(path) if exists(spark, path) else None
    text_dictionary(texts, known_zones(spark), known).write.mode("append").parquet(path)
    words = spark.read.schema(schema).parquet(path)
    return words if known is None else words.dropDuplicates(["raw", "zone", "day_first"])


def normalize_instants(
    rows: DataFrame, key: str, columns: list[str], source: str, sources: DataFrame, dictionary_path: str | None = None
) -> DataFrame:
    """Distinct ``(<key>, field_name, utc_us)``: one row for each readable value of ``columns``.

    ``sources`` has ``source_id``, ``time_zone`` and ``day_first``. Texts are
    deduplicated with zone and day order into a dictionary that is parsed exhaustively
    once and stored; the instants are joined back to the rows. With
    ``dictionary_path`` the dictionary is kept there and only grows by new texts.

    Defined cases: null, blank and unreadable texts give no row; a row whose source is
    null or unknown has neither zone nor day order, so only its zoned texts and dates
    count (numeric ones month first). Repeated rows give one row. Empty tables give no
    rows. Further columns of ``rows`` play no part.

    Scale: the parse runs over distinct texts only, inside generated code. The join
    back is on the text: a spelling in a third of all rows is one dictionary row, and
    its side of the join is what adaptive execution splits.
    """
    spark = rows.sparkSession
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).cast("string").alias("raw")) for c in columns]))
    known = sources.select(
        F.col("source_id").alias("_sid"), F.col("time_zone").alias("zone"), F.col("day_first").cast("boolean").alias("day_first")
    ).dropDuplicates(["_sid"])
    texts = (
        rows.select(F.col(key).alias("_key"), F.col(source).alias("_source"), pairs.alias("_v"))
        .select("_key", "_source", "_v.field_name", "_v.raw")
        .where(r"raw rlike '\\S'")
        .join(known, F.col("_source") == F.col("_sid"), "left")
        .select("_key", "field_name", "raw", F.coalesce("zone", F.lit("")).alias("zone"), F.coalesce("day_first", F.lit(False)).alias("day_first"))
    )
    if dictionary_path:
        words = append_dictionary(texts, dictionary_path)
    else:
        words = stored(text_dictionary(texts, known_zones(spark)), "instants")
    words = words.where("utc_us is not null")
    return (
        texts.join(words, ["raw", "zone", "day_first"])
        .select(F.col("_key").alias(key), "field_name", "utc_us")
        .distinct()
    )
