"""Consolidating pairwise matches into groups: connected components by randomised contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriplane.runtime import drop_stored, stored, stored_count


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def contract(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(id, group_id)`` for every vertex of ``edges`` that has a link to another one.

    Each round draws a fresh hash order of the vertices. Every vertex hooks to the
    smallest of itself and its neighbours in that order; edges are relabelled to the
    chosen representatives, and loops and repeats vanish. When no edge is left the
    mappings of the rounds are expanded from the last to the first. ``group_id`` is the
    smallest id of the component.

    Defined cases: links with a null end or with equal ends are ignored, repeats and
    reversed repeats count once, no links give no rows. Other columns of ``edges`` play
    no part.

    Scale: a round is one aggregate and two joins over the edges that remain, which shrink
    by a constant factor in expectation whatever the shape (long chains, stars). The hook
    is a partial minimum, so a vertex with a third of all links sends one row per map task.
    The driver sees row counts only.
    """
    links, left = stored_count(
        edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
        .where("a is not null and b is not null and a <> b")
        .select(*_ordered(F.col("a"), F.col("b")))
        .distinct(),
        "links",
    )
    rounds: list[DataFrame] = []
    while left:
        seed = F.lit(0x5EED + len(rounds))
        rank = lambda c: F.struct(F.xxhash64(seed, F.col(c)).alias("h"), F.col(c).alias("id"))  # noqa: E731, B023
        both = links.select("u", rank("v").alias("r")).unionByName(links.select(F.col("v").alias("u"), rank("u").alias("r")))
        hooks = both.groupBy("u").agg(F.min("r").alias("r")).select("u", F.least(F.col("r"), rank("u"))["id"].alias("rep"))
        hooks = stored(hooks, "hooks")
        rounds.append(hooks)
        ends = lambda side: hooks.select(F.col("u").alias(side), F.col("rep").alias(f"{side}_rep"))  # noqa: E731, B023
        nxt, left = stored_count(
            links.join(ends("u"), "u").join(ends("v"), "v").where("u_rep <> v_rep").select(*_ordered(F.col("u_rep"), F.col("v_rep"))).distinct(),
            "links",
        )
        drop_stored(links)
        links = nxt
    if not rounds:
        return edges.sparkSession.createDataFrame([], edges.select(F.col(a).alias("id"), F.col(a).alias("group_id")).schema)
    top = rounds[-1]
    for lower in reversed(rounds[:-1]):
        upper = top.select(F.col("u").alias("rep"), F.col("rep").alias("root"))
        top = lower.join(upper, "rep", "left").select("u", F.coalesce("root", "rep").alias("rep"))
    top = stored(top, "roots")
    drop_stored(links, *rounds)
    smallest = top.groupBy("rep").agg(F.min("u").alias("group_id"))
    return top.join(smallest, "rep").select(F.col("u").alias("id"), "group_id")


def accepted_links(candidates: DataFrame, decisions: DataFrame, entities: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Distinct pairs ``(u, v)``, u < v, that count as links.

    A pair counts if its verdict is confirm, or if it has no verdict and its highest
    candidate confidence reaches ``threshold``. The verdict is the decision with the
    latest ``decided_at`` (of ties the highest ``log_pos``; unreadable times come first);
    anything but confirm or reject, case and blanks ignored, is no verdict. Pairs with
    equal, null or unknown ends don't count. Order within a pair is ignored.
    """
    pair = _ordered(F.col("entity_a"), F.col("entity_b"))
    real = "entity_a is not null and entity_b is not null and entity_a <> entity_b"
    verdicts = (
        decisions.where(real)
        .select(*pair, F.struct(F.try_to_timestamp(F.trim("decided_at")).alias("t"), F.col("log_pos"), F.lower(F.regexp_replace("decision", r"^\s+|\s+$", "")).alias("verdict")).alias("d"))
        .groupBy("u", "v")
        .agg(F.max("d")["verdict"].alias("verdict"))
    )
    scored = candidates.where(real).select(*pair, "confidence").groupBy("u", "v").agg(F.max(F.nanvl("confidence", F.lit(None).cast("double"))).alias("confidence"))
    verdict = F.coalesce("verdict", F.lit(""))
    links = scored.join(verdicts, ["u", "v"], "full").where(
        (verdict == "confirm") | (~verdict.isin("confirm", "reject") & (F.coalesce("confidence", F.lit(-1.0)) >= threshold))
    )
    known = entities.select(F.col("entity_id").alias("id")).where("id is not null").distinct()
    for side in ("u", "v"):
        links = links.join(known.withColumnRenamed("id", side), side, "left_semi")
    return links.select("u", "v")


def link_groups(candidates: DataFrame, decisions: DataFrame, entities: DataFrame, threshold: float = 0.90) -> DataFrame:
    """``(entity_id, group_id)`` for every entity in a group of at least two."""
    return contract(accepted_links(candidates, decisions, entities, threshold), "u", "v").withColumnRenamed("id", "entity_id")
