"""Best representative of each duplicate group: field by field, with a latent two-sided model of source quality."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriplane.functions.codes import STATE_NAMES, valid_npi
from veriplane.runtime import stored

# Words that fill a name field without naming anybody.
FILLER_WORDS = (
    "N A NA NONE NULL NIL UNKNOWN UNK TBD TBA TEST RECORD NOT ON FILE NAME AVAILABLE PROVIDED APPLICABLE PROVIDER ENTITY "
    "PENDING MISSING BLANK REDACTED ANONYMOUS SEE ABOVE SAME NO DATA DUMMY SAMPLE TO BE DETERMINED"
).split()


def usable_name(raw: Column) -> Column:
    """The name in upper case with single blanks, or null if it names nobody.

    No letters at all, one letter alone or repeated, or nothing but filler words name nobody.
    """
    words = F.trim(F.regexp_replace(F.upper(raw), r"[^\p{L}\p{N}]+", " "))
    tokens = F.split(words, " ")
    filler = F.forall(tokens, lambda t: t.isin(*FILLER_WORDS) | t.rlike(r"^[0-9]+$"))
    repeated = words.rlike(r"^(\p{L})(?:\s*+\1)*+$")
    return F.when(words.rlike(r"\p{L}") & ~filler & ~repeated, words)


def usable_state(raw: Column) -> Column:
    code = F.upper(F.regexp_replace(raw, r"\s+", ""))
    return F.when(code.isin(*STATE_NAMES), code)


def usable_npis(raw: Column) -> Column:
    """The distinct valid numbers of a list; null if there is none."""
    good = F.array_distinct(F.transform(F.filter(raw, valid_npi), lambda x: F.trim(x)))
    return F.when(F.size(good) > 0, good)


def _claims(records: DataFrame, sources: DataFrame) -> DataFrame:
    """One row for each usable value of each record and field."""
    ranks = sources.select(F.col("source_id").alias("_sid"), F.col("trust_rank").cast("long").alias("trust_rank")).dropDuplicates(["_sid"])
    one = lambda name, value: F.struct(F.lit(name).alias("field_name"), F.when(value.isNotNull(), F.array(value)).alias("vals"))
    fields = F.array(
        one("canonical_name", usable_name(F.col("canonical_name"))),
        one("canonical_state", usable_state(F.col("canonical_state"))),
        F.struct(F.lit("npis").alias("field_name"), usable_npis(F.col("npis")).alias("vals")),
    )
    return (
        records.where("group_id is not null and record_id is not null")
        .select(
            "group_id", "record_id", "observed_at", F.coalesce("source_id", F.lit("")).alias("source_id"),
            F.explode(fields).alias("f"),
        )
        .select("group_id", "record_id", "observed_at", "source_id", "f.field_name", F.explode("f.vals").alias("value"))
        .join(ranks, F.col("source_id") == F.col("_sid"), "left")
        .drop("_sid")
    )


def claim_facts(records: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per (group, field, value): who asserts it, who speaks of the field without asserting it, and its best record.

    Only groups with at least two different records. ``best`` orders by trust rank
    (unknown source last), then latest observation (none last).
    """
    claims = _claims(records, sources)
    plural = (
        records.where("group_id is not null and record_id is not null")
        .groupBy("group_id")
        .agg(F.min("record_id").alias("lo"), F.max("record_id").alias("hi"))
        .where("lo <> hi")
        .select("group_id")
    )
    last = F.lit(2**62).cast("long")
    best = F.struct(
        F.coalesce("trust_rank", last).alias("rank"),
        F.coalesce(-F.unix_micros(F.col("observed_at").cast("timestamp")), last).alias("age"),
        F.col("record_id"),
    )
    values = (
        claims.join(plural, "group_id", "left_semi")
        .groupBy("group_id", "field_name", "value")
        .agg(F.min(best).alias("best"), F.array_sort(F.collect_set("source_id")).alias("pos"))
    )
    # the sources of a group and field: a union of sets no longer than the list of sources
    speakers = values.select("group_id", "field_name", F.explode("pos").alias("s")).groupBy("group_id", "field_name").agg(F.array_sort(F.collect_set("s")).alias("all"))
    return values.join(speakers, ["group_id", "field_name"]).select("*", F.array_except("all", "pos").alias("neg")).drop("all")


def source_quality(facts: DataFrame, rounds: int = 8, most_patterns: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """Expectation-maximisation over latent truths.

    Returns ``(quality, posteriors)``: per field and source sensitivity (it asserts a true
    value) and specificity (it leaves out a false one), and per field and
    pattern of asserting and silent sources the probability that the value is true.

    Facts with the same pattern are alike to the model, so they are counted once and the
    iterations run over patterns, however many facts there are. Weak Beta priors
    (sensitivity 8:2, specificity 9:1, truth 1:1) keep estimates of rare sources sane.
    Up to ``most_patterns`` patterns (a few sources make few) are fitted on the driver, more of them by the executors, by the same formulas.
    """
    patterns = stored(facts.groupBy("field_name", "pos", "neg").agg(F.count("*").alias("n")), "patterns")
    few = patterns.limit(most_patterns + 1).collect()
    return _fit_here(patterns, few, rounds) if len(few) <= most_patterns else _fit_there(patterns, rounds)


def _fit_here(patterns: DataFrame, rows: list, rounds: int) -> tuple[DataFrame, DataFrame]:
    """The model fitted in arrays; ``rows`` are all ``patterns``."""
    spark = patterns.sparkSession
    quality, posteriors = [], []
    for field in sorted({r["field_name"] for r in rows}):
        mine = [r for r in rows if r["field_name"] == field]
        sources = sorted({s for r in mine for s in [*r["pos"], *r["neg"]]})
        at = {s: i for i, s in enumerate(sources)}
        says, silent = np.zeros((2, len(mine), len(sources)))
        for n, r in enumerate(mine):
            says[n, [at[s] for s in r["pos"]]] = 1
            silent[n, [at[s] for s in r["neg"]]] = 1
        count = np.asarray([r["n"] for r in mine], dtype=float)
        p = np.clip(says.sum(1) / (says + silent).sum(1), 0.05, 0.95)
        for _ in range(rounds):
            true, false = count * p, count * (1 - p)
            sens = (true @ says + 8) / (true @ (says + silent) + 10)
            spec = (false @ silent + 9) / (false @ (says + silent) + 10)
            prior = (true.sum() + 1) / (count.sum() + 2)
            llr = says @ np.log(sens / (1 - spec)) + silent @ np.log((1 - sens) / spec)
            p = 1 / (1 + np.exp(-(llr + np.log(prior / (1 - prior)))))
        quality += [(field, s, float(a), float(b)) for s, a, b in zip(sources, sens, spec)]
        posteriors += [(field, r["pos"], r["neg"], float(x)) for r, x in zip(mine, p)]
    return (
        spark.createDataFrame(quality, "field_name string, source_id string, sensitivity double, specificity double"),
        spark.createDataFrame(posteriors, "field_name string, pos array<string>, neg array<string>, probability double"),
    )


def _fit_there(patterns: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """The model fitted over a table of patterns."""
    votes = patterns.select("field_name", "pos", "neg", "n", F.explode(F.concat(
        F.transform("pos", lambda s: F.struct(s.alias("source_id"), F.lit(1).alias("says"))),
        F.transform("neg", lambda s: F.struct(s.alias("source_id"), F.lit(0).alias("says"))),
    )).alias("v")).select("field_name", "pos", "neg", "n", "v.*")
    share = F.size("pos") / (F.size("pos") + F.size("neg"))
    belief = patterns.select("*", F.least(F.lit(0.95), F.greatest(F.lit(0.05), share)).alias("p"))
    quality = None
    for _ in range(rounds):
        believed = votes.join(belief.select("field_name", "pos", "neg", "p"), ["field_name", "pos", "neg"])
        hit = lambda cond, w: F.sum(F.when(cond, F.col("n") * w).otherwise(0.0))
        p = F.col("p")
        quality = stored(
            believed.groupBy("field_name", "source_id").agg(
                ((hit(F.col("says") == 1, p) + 8) / (hit(F.lit(True), p) + 10)).alias("sensitivity"),
                ((hit(F.col("says") == 0, 1 - p) + 9) / (hit(F.lit(True), 1 - p) + 10)).alias("specificity"),
            ),
            "quality",
        )
        prior = belief.groupBy("field_name").agg(((F.sum(p * F.col("n")) + 1) / (F.sum("n") + 2)).alias("prior"))
        sens, spec = F.col("sensitivity"), F.col("specificity")
        ratio = F.sum(F.when(F.col("says") == 1, F.log(sens / (1 - spec))).otherwise(F.log((1 - sens) / spec)))
        odds = votes.join(quality, ["field_name", "source_id"]).groupBy("field_name", "pos", "neg").agg(ratio.alias("llr"))
        belief = stored(
            patterns.join(odds, ["field_name", "pos", "neg"])
            .join(prior, "field_name")
            .select("field_name", "pos", "neg", "n", (1 / (1 + F.exp(-(F.col("llr") + F.log(F.col("prior") / (1 - F.col("prior"))))))).alias("p")),
            "belief",
        )
    return quality, belief.select("field_name", "pos", "neg", F.col("p").alias("probability"))


def judged_values(records: DataFrame, sources: DataFrame, rounds: int = 8) -> DataFrame:
    """Every distinct usable value of every group with its probability of being true.

    ``retained`` marks what the surviving record holds: of single-valued fields the
    value of the surviving record, of ``npis`` every value judged true (0.5 or more) and
    those of the surviving record.
    """
    facts = stored(claim_facts(records, sources), "facts")
    _, posteriors = source_quality(facts, rounds)
    scored = facts.join(posteriors, ["field_name", "pos", "neg"])
    order = F.struct(F.col("best.rank"), F.col("best.age"), (-F.round("probability", 9)).alias("doubt"), F.col("best.record_id"), F.col("value"))
    chosen = scored.groupBy("group_id", "field_name").agg(F.min(order).alias("top"))
    single = F.col("field_name") != "npis"
    return scored.join(chosen, ["group_id", "field_name"]).select(
        "group_id", "field_name", "value", F.col("best.record_id").alias("value_record_id"), F.col("top.record_id").alias("record_id"),
        "probability", F.size("pos").cast("long").alias("n_sources"),
        F.when(single, F.col("value") == F.col("top.value"))
        .otherwise((F.col("probability") >= 0.5) | (F.col("best") == F.struct(F.col("top.rank"), F.col("top.age"), F.col("top.record_id"))))
        .alias("retained"),
    )


def surviving_fields(records: DataFrame, sources: DataFrame, rounds: int = 8) -> DataFrame:
    """``(group_id, field_name, record_id)``: the record each surviving value is taken from.

    A record qualifies with a usable value; the most trusted source wins, then the latest
    observation, then the value more probably true under the latent quality model, then
    the smallest record_id. Groups with fewer than two different records, and fields
    without a usable value, give no row.

    Defined cases: rows without group or record id are ignored; rows with a null or
    unknown source rank last; a null observation time is the oldest; repeated rows
    count once. Columns beyond those named in the schema play no part.

    Scale: minima and sets are partial aggregates, no group is gathered in one place.
    """
    return judged_values(records, sources, rounds).select("group_id", "field_name", "record_id").distinct()
