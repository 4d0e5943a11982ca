"""What changed between consecutive full snapshots of one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _exact(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def snapshot_changes(
    rows: DataFrame,
    run: str,
    key: str,
    order: str,
    exact: list[str],
    tolerant: dict[str, float] | None = None,
) -> DataFrame:
    """Rows ``(from_run, to_run, <key>, change_kind)`` for each two consecutive runs.

    Within a run the row with the highest ``order`` stands for its key. Each key's
    rows are put in the order of the snapshot index: a gap before a row is an
    addition, a gap after it a removal; without a gap the lagged hash of the
    ``exact`` columns and the lagged ``tolerant`` numbers (column -> largest
    difference that is no change) tell whether it changed.

    Defined cases: rows whose run is null, or whose key is null or empty, are
    ignored, but a run made up of such rows still counts as a (then empty)
    snapshot. In ``exact`` columns null equals empty. In ``tolerant`` columns null
    equals only null, NaN only NaN. Of rows tied in ``order`` the greatest values
    win; null order is lowest. An empty table or a single run gives no rows.
    Further columns of ``rows``, whatever their names, play no part.

    Scale: rows are reduced to one per run and key by a map-side aggregate, so a key
    in a third of all rows costs no more than one row per run after the shuffle. The
    snapshot index is a table with one row per run.
    """
    tolerant = tolerant or {}
    tol = list(tolerant)
    source = rows.select(
        F.col(run).alias("_run"),
        F.col(key).alias("_key"),
        F.struct(
            F.col(order).alias("_order"),
            *[_exact(F.col(c)).alias(f"_e{i}") for i, c in enumerate(exact)],
            *[F.col(c).cast("double").alias(f"_t{i}") for i, c in enumerate(tol)],
        ).alias("_row"),
    ).where("_run is not null")
    numbered = Window.orderBy("_run")
    runs = source.select("_run").distinct()
    # one row per snapshot: the only global order here, over the list of run numbers
    runs = runs.select(
        "_run",
        F.row_number().over(numbered).alias("_idx"),
        F.lag("_run").over(numbered).alias("_before"),
        F.lead("_run").over(numbered).alias("_after"),
    )
    current = (
        source.where("_key is not null and cast(_key as string) <> ''")
        .groupBy("_run", "_key")
        .agg(F.max("_row").alias("_row"))
        .join(runs, "_run")
        .select(
            "_run", "_key", "_idx", "_before", "_after",
            F.xxhash64(*[F.col(f"_row._e{i}") for i in range(len(exact))], F.lit(0)).alias("_hash"),
            *[F.col(f"_row._t{i}").alias(f"_t{i}") for i in range(len(tol))],
        )
    )
    w = Window.partitionBy("_key").orderBy("_idx")
    seen = current.select(
        "*",
        F.lag("_idx").over(w).alias("_prev_idx"),
        F.lead("_idx").over(w).alias("_next_idx"),
        F.lag("_hash").over(w).alias("_prev_hash"),
        *[F.lag(f"_t{i}").over(w).alias(f"_p{i}") for i in range(len(tol))],
    )
    changed = F.col("_hash") != F.col("_prev_hash")
    for i, c in enumerate(tol):
        now, was = F.col(f"_t{i}"), F.col(f"_p{i}")
        differs = F.when(now.isNull() | was.isNull(), ~now.eqNullSafe(was)).otherwise(
            F.when(F.isnan(now) | F.isnan(was), now != was).otherwise(F.abs(now - was) > F.lit(float(tolerant[c])))
        )
        changed = changed | differs
    follows = F.coalesce(F.col("_prev_idx") == F.col("_idx") - 1, F.lit(False))
    stays = F.coalesce(F.col("_next_idx") == F.col("_idx") + 1, F.lit(False))
    events = F.array_compact(
        F.array(
            F.when(~follows & F.col("_before").isNotNull(), F.struct(F.col("_before").alias("f"), F.col("_run").alias("t"), F.lit("added").alias("k"))),
            F.when(follows & changed, F.struct(F.col("_before").alias("f"), F.col("_run").alias("t"), F.lit("changed").alias("k"))),
            F.when(~stays & F.col("_after").isNotNull(), F.struct(F.col("_run").alias("f"), F.col("_after").alias("t"), F.lit("removed").alias("k"))),
        )
    )
    return seen.select("_key", F.explode(events).alias("_ev")).select(
        F.col("_ev.f").alias("from_run"),
        F.col("_ev.t").alias("to_run"),
        F.col("_key").alias(key),
        F.col("_ev.k").alias("change_kind"),
    )
