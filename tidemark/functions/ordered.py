"""Ordered look-back that survives a hot key.

A plain ``lag`` sorts a whole key in one task. Here a key is cut into segments of the
order column; each (key, segment) is looked at on its own and the first row of a
segment takes what the nearest earlier segment of the key ended with. The second pass
sees one row per (key, segment). Results equal the plain window functions.

Both passes hang on the same exchange by (key, segment), so the rows are produced once
as long as they hold no columns beyond keys, order and values. Rows without a key form a
group of their own, as they do in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _with_carry(looked: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """Joins the carried value of each (key, segment).

    The comparison is null-safe. That keeps rows without a key, and it keeps the optimiser
    from adding a not-null filter on one side only, which would undo the shared exchange.
    """
    names = [*keys, "_seg"]
    right = carried.select(*[F.col(k).alias(f"_r_{k}") for k in names], "_carry")
    same = None
    for k in names:
        test = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        same = test if same is None else same & test
    return looked.join(right, same, "inner").drop(*[f"_r_{k}" for k in names])


def with_previous(
    rows: DataFrame, keys: list[str], order: list[str], values: list[str], segment: Column, name: str = "prev"
) -> DataFrame:
    """Adds ``name``: struct of ``values`` of the row before, NULL on the first row of a key."""
    inside = Window.partitionBy(*keys, "_seg").orderBy(*order)
    looked = rows.withColumn("_seg", segment).select(
        "*", F.lag(F.struct(*values)).over(inside).alias("_lag"), F.lead(F.lit(1)).over(inside).isNull().alias("_ends")
    )
    tails = looked.filter("_ends").select(*keys, "_seg", F.struct(*values).alias("_tail"))
    across = Window.partitionBy(*keys).orderBy("_seg")
    carried = tails.select(*keys, "_seg", F.lag("_tail").over(across).alias("_carry"))
    joined = _with_carry(looked, carried, keys)
    return joined.withColumn(name, F.coalesce("_lag", "_carry")).drop("_seg", "_lag", "_carry", "_ends")


def with_last_known(
    rows: DataFrame, keys: list[str], order: list[str], value: Column, segment: Column, name: str = "last_known"
) -> DataFrame:
    """Adds the latest non-NULL ``value`` at or before each row of its key."""
    parts, ordering = ", ".join([*keys, "_seg"]), ", ".join(order)
    inside = Window.partitionBy(*keys, "_seg").orderBy(*order)
    looked = rows.withColumn("_seg", segment).withColumn("_val", value).select(
        "*",
        F.expr(
            f"last(_val) IGNORE NULLS OVER (PARTITION BY {parts} ORDER BY {ordering} "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        ).alias("_here"),
        F.lead(F.lit(1)).over(inside).isNull().alias("_ends"),
    )
    tails = looked.filter("_ends").select(*keys, "_seg", F.col("_here").alias("_tail"))
    carried = tails.select(
        *keys, "_seg",
        F.expr(
            f"last(_tail) IGNORE NULLS OVER (PARTITION BY {', '.join(keys)} ORDER BY _seg "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        ).alias("_carry"),
    )
    joined = _with_carry(looked, carried, keys)
    return joined.withColumn(name, F.coalesce("_here", "_carry")).drop("_seg", "_val", "_here", "_carry", "_ends")


def with_last_two(
    rows: DataFrame, keys: list[str], order: list[str], value: Column, segment: Column,
    names: tuple[str, str] = ("last_known", "one_before"),
) -> DataFrame:
    """Adds the latest and the second latest non-NULL ``value`` of the rows before each row of its key."""
    over = f"OVER (PARTITION BY {', '.join([*keys, '_seg'])} ORDER BY {', '.join(order)})"
    across = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY _seg)"
    looked = rows.withColumn("_seg", segment).withColumn("_val", value).select(
        "*", F.expr(f"lag(_val, 1) IGNORE NULLS {over}").alias("_one"), F.expr(f"lag(_val, 2) IGNORE NULLS {over}").alias("_two"),
        F.expr(f"lead(1) {over} IS NULL").alias("_ends"),
    )
    last = F.coalesce("_val", "_one")
    second = F.when(F.col("_val").isNotNull(), F.col("_one")).otherwise(F.col("_two"))
    tails = looked.filter("_ends").select(
        *keys, "_seg", F.when(last.isNotNull(), F.struct(last.alias("last"), second.alias("second"))).alias("_tail")
    )
    # The second latest value may lie one segment further back than the latest.
    carried = tails.select(*keys, "_seg", F.struct(
        F.expr(f"lag(_tail, 1) IGNORE NULLS {across}").alias("near"), F.expr(f"lag(_tail, 2) IGNORE NULLS {across}").alias("far")
    ).alias("_carry"))
    joined = _with_carry(looked, carried, keys)
    near, far = F.col("_carry.near"), F.col("_carry.far")
    before = (
        F.when(F.col("_one").isNull(), F.coalesce(near["second"], far["last"]))
        .when(F.col("_two").isNull(), near["last"])
        .otherwise(F.col("_two"))
    )
    return joined.withColumn(names[1], before).withColumn(names[0], F.coalesce(F.col("_one"), near["last"])).drop(
        "_seg", "_val", "_one", "_two", "_carry", "_ends"
    )
