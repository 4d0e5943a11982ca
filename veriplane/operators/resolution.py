"""Entity resolution over records (name, npi, state): anchors, phonetic blocks, pair scores, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from veriplane.functions.names import edit_similarity, jaccard, normalize_name, phonetic_keys, token_similarity, tokens
from veriplane.runtime import drop_stored, stored

MERGE, REVIEW = 0.90, 0.72


def features(records: DataFrame) -> DataFrame:
    """``records`` (idx, name, npi, state) with norm, words and phonetic keys."""
    return records.withColumn("norm", normalize_name(F.col("name"))).withColumns({"words": F.array_distinct(tokens(F.col("norm"))), "phon": phonetic_keys(F.col("norm"))})


def anchor_edges(records: DataFrame) -> DataFrame:
    """Links of each record to the first record with its number, and to the first with its normal name unless both numbers are known and differ."""
    by_npi = records.where("npi is not null").groupBy("npi").agg(F.min("idx").alias("anchor"))
    by_norm = records.where("norm <> ''").groupBy("norm").agg(F.min(F.struct("idx", "npi")).alias("a"))
    named = records.join(by_norm, "norm").where("not (npi is not null and a.npi is not null and npi <> a.npi)").select("idx", F.col("a.idx").alias("anchor"))
    return records.join(by_npi, "npi").select("idx", "anchor").unionByName(named).where("idx <> anchor").distinct()


def _scored(records: DataFrame, max_block: int) -> DataFrame:
    """``(i, j, raw, signals)``: see ``pair_scores``; the score is not rounded."""
    rec = features(records)
    keyed = rec.select("idx", F.explode("phon").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n").between(2, max_block)).select("key")
    keyed = keyed.join(sizes, "key")
    pairs = keyed.withColumnRenamed("idx", "i").join(keyed.withColumnRenamed("idx", "j"), "key").where("i < j").select("i", "j").distinct()
    side = lambda s: rec.select(*[F.col(c).alias(f"{c}_{s}") for c in ("idx", "norm", "npi", "state", "words", "phon")])
    both = pairs.join(side("i"), F.col("i") == F.col("idx_i")).join(side("j"), F.col("j") == F.col("idx_j"))
    both = both.where("norm_i <> norm_j and not (npi_i is not null and npi_j is not null and npi_i <> npi_j)")
    cheap = both.select(
        "i", "j", "norm_i", "norm_j",
        token_similarity(F.col("words_i"), F.col("words_j")).alias("token"),
        jaccard(F.col("phon_i"), F.col("phon_j")).alias("phonetic"),
        F.when(F.lower("state_i") == F.lower("state_j"), 0.05).otherwise(0.0).alias("bonus"),
    ).where(0.6 + 0.25 * F.col("token") + 0.15 * F.col("phonetic") + F.col("bonus") >= REVIEW)
    scored = cheap.withColumn("edit", edit_similarity(F.col("norm_i"), F.col("norm_j")))
    score = F.least(F.lit(1.0), 0.6 * F.col("edit") + 0.25 * F.col("token") + 0.15 * F.col("phonetic") + F.col("bonus"))
    fired = [("edit", 0.6, "name_edit_distance"), ("token", 0.5, "name_token_overlap"), ("phonetic", 0.5, "name_phonetic"), ("bonus", 0.0, "state_match")]
    signals = F.array_compact(F.array(*[F.when(F.col(c) > least, name) for c, least, name in fired]))
    return scored.select("i", "j", score.alias("raw"), signals.alias("signals")).where(F.col("raw") >= REVIEW)


def pair_scores(records: DataFrame, max_block: int = 400) -> DataFrame:
    """``(i, j, score, signals)`` of record pairs in a common phonetic block with score 0.72 or more.

    Pairs of equal normal name, and pairs of different known numbers, are not compared. A
    block of more than ``max_block`` records is left out whole, as the resolution defines it; a pair may meet in another one.
    """
    return _scored(records, max_block).select("i", "j", F.round("raw", 4).alias("score"), "signals")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(id, component)``: the smallest id linked to each vertex, by label propagation with pointer jumping.

    A round is one job; what moved is counted as the labels are written.
    """
    one = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))  # the edges are computed once
    both = stored(one.select(F.inline(ways)).distinct(), "edges")
    labels = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("label")), "labels")
    while True:
        heard = both.join(labels.select(F.col("id").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, labels["id"] == heard["u"]).select("id", F.least("label", "heard").alias("next"), "label")
        jump = labels.select(F.col("id").alias("next"), F.col("label").alias("far"))
        far = F.least("next", F.coalesce("far", "next"))
        moved = Observation()
        new = nearer.join(jump, "next", "left").select("id", far.alias("label"), (far != F.col("label")).alias("moved"))
        new = stored(new.observe(moved, F.count_if("moved").alias("n")).drop("moved"), "labels")
        drop_stored(labels)
        labels = new
        if not moved.get["n"]:
            drop_stored(both)
            return labels.select("id", F.col("label").alias("component"))


def resolve(records: DataFrame, confirmed: DataFrame | None = None, max_block: int = 400) -> DataFrame:
    """``(idx, cluster)`` for every record; ``confirmed`` (i, j) are links a person decided, merged as well."""
    return resolve_pairs(records, _scored(records, max_block), confirmed)


def resolve_pairs(records: DataFrame, scored: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """As ``resolve``, with the scored pairs (i, j, raw) given."""
    edges = anchor_edges(features(records)).select(F.col("idx").alias("i"), F.col("anchor").alias("j"))
    edges = edges.unionByName(scored.where(F.col("raw") >= MERGE).select("i", "j"))
    if confirmed is not None:
        edges = edges.unionByName(confirmed.select("i", "j"))
    groups = components(edges, "i", "j")
    return records.join(groups, records["idx"] == groups["id"], "left").select("idx", F.coalesce("component", "idx").alias("cluster"))


def modal(values: DataFrame, key: str, value: str, weight: str | None = None) -> DataFrame:
    """``(<key>, <value>)``: the most frequent non-blank value; then the longer in bytes, then the smaller. ``weight`` counts a row several times."""
    count = F.sum(weight) if weight else F.count("*")
    counted = values.where(f"trim({value}) <> ''").groupBy(key, value).agg(count.alias("n"))
    order = F.struct((-F.col("n")).alias("a"), (-F.octet_length(F.col(value))).alias("b"), F.col(value).alias("v"))
    return counted.groupBy(key).agg(F.min(order)["v"].alias(value))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the highest ``order`` of each key; of ties the one whose other columns are greatest, compared as text by name."""
    rest = [F.desc(F.col(c).cast("string")) for c in sorted(rows.columns) if c not in keys and c != order]
    w = Window.partitionBy(*keys).orderBy(F.desc(order), *rest)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
