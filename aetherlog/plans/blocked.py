"""Running values over long ordered series, split into blocks.

A window partitioned by one series runs that series in one task. One receiver
or aircraft may own a third of all rows, so every running value here works in
two steps:

1. inside a block (``key`` + a slice of time or of frame numbers) with an
   ordinary window, so a long series spreads over many tasks;
2. between blocks, on one summary row per block, to get the value carried in.

The rows are shuffled once, by key and block, and read twice: the partial sums of
the summaries are taken before the shuffle. The summaries are small, and the
join that brings the carried value back uses the partitioning of step 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_block"


def time_block(ts: str | Column, seconds: int = 3600) -> Column:
    """Block number of a timestamp."""
    return F.floor(F.unix_timestamp(ts) / F.lit(seconds)).cast("bigint")


def index_block(idx: str | Column, size: int = 36000) -> Column:
    """Block number of a row index."""
    idx = F.col(idx) if isinstance(idx, str) else idx
    return F.floor(idx / F.lit(size)).cast("bigint")


ROWS_PER_BLOCK = "spark.aetherlog.rowsPerBlock"  # session setting: the rows of a block beyond which it is cut
_CUTS = 256


def cut_dense(rows: DataFrame, key: list[str], lead: str) -> DataFrame:
    """Cut blocks with more rows than the session allows, at quantiles of the first order column.

    Without the setting the blocks stay. Only blocks that are too full are sketched; each is cut into at most 256 parts, so that a
    part of a block holds about the allowed number of rows up to 256 times that number. Rows of one instant stay together.
    Results do not depend on the cuts.
    """
    limit = rows.sparkSession.conf.get(ROWS_PER_BLOCK, None)
    if not limit:
        return rows
    part = [*key, BLOCK]
    full = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > int(limit))
    points = F.percentile_approx(lead, [i / _CUTS for i in range(1, _CUTS)])
    # every k-th of the 255 quantiles, for about n / limit parts
    step = F.greatest(F.lit(1), F.floor(F.lit(_CUTS) * int(limit) / F.max("_n"))).cast("int")
    bounds = rows.select(*part, lead).join(full, part).groupBy(*part).agg(points.alias("_q"), step.alias("_step"))
    bounds = bounds.select(*part, F.array_distinct(F.filter("_q", lambda q, i: (i + 1) % F.col("_step") == 0)).alias("_q"))
    nth = F.coalesce(F.size(F.filter("_q", lambda q: q < F.col(lead))), F.lit(0))
    return rows.join(bounds, part, "left").withColumn(
        BLOCK, F.struct(F.col(BLOCK).alias("b"), F.when(F.col("_q").isNull(), 0).otherwise(nth).alias("part"))).drop("_q")


def running(
    df: DataFrame,
    key: list[str],
    order: list[str],
    block: Column,
    **specs: tuple,
) -> DataFrame:
    """Add running columns, equal to plain windows over ``key`` ordered by ``order``.

    Each spec is ``name=(kind, column)``:

    - ``sum``: running sum up to and including the row (NULL counts as 0);
    - ``since``: ``(kind, value, reset)``, sum of the values after the newest row with ``reset``;
    - ``last``: newest non-NULL value up to and including the row;
    - ``max``: largest value up to and including the row;
    - ``before``: newest non-NULL value of the rows before;
    - ``lag`` / ``lead``: value of the row before / after, NULL at the ends.

    ``block`` must not decrease along ``order``; ``key`` and ``order`` must not be NULL.
    """
    part = [*key, BLOCK]
    rows = cut_dense(df.withColumn(BLOCK, block), key, order[0])
    inside = Window.partitionBy(*part).orderBy(*order)
    up_to = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*key).orderBy(BLOCK)
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order)
    zero = F.lit(0)

    sums = {f"_p_{n}": F.sum(v[1]).over(up_to) for n, v in specs.items() if v[0] == "since"}
    rows = rows.withColumns(sums) if sums else rows

    local, totals, carried, merged = {}, [], [], {}
    for name, (kind, value, *reset) in specs.items():
        here, total, carry = f"_l_{name}", f"_t_{name}", f"_c_{name}"
        if kind in ("sum", "since"):
            totals.append(F.sum(value).alias(total))
            carried.append(F.coalesce(F.sum(total).over(earlier), zero).alias(carry))
        if kind == "sum":
            local[here] = F.sum(value).over(up_to)
            merged[name] = F.coalesce(F.col(here), zero) + F.coalesce(F.col(carry), zero)
        elif kind == "since":
            so_far = F.coalesce(F.col(f"_p_{name}"), zero)
            local[here] = F.last(F.when(reset[0], so_far), ignorenulls=True).over(up_to)
            totals.append(F.max_by(so_far, F.when(reset[0], at)).alias(f"_r_{name}"))
            base = F.coalesce(F.sum(total).over(earlier), zero) + F.col(f"_r_{name}")
            carried.append(base.alias(f"_b_{name}"))
            merged[name] = F.when(
                F.col(here).isNotNull(), so_far - F.col(here)
            ).otherwise(so_far + F.col(carry) - F.coalesce(F.col(f"_k_{name}"), zero))
        elif kind == "max":
            local[here] = F.max(value).over(up_to)
            totals.append(F.max(value).alias(total))
            carried.append(F.max(total).over(earlier).alias(carry))
            merged[name] = F.greatest(here, carry)
        elif kind == "last":
            local[here] = F.last(value, ignorenulls=True).over(up_to)
        elif kind == "before":
            frame = inside.rowsBetween(Window.unboundedPreceding, -1)
            local[here] = F.last(value, ignorenulls=True).over(frame)
        elif kind in ("lag", "lead"):
            boxed = F.struct(value.alias("v"))
            step, edge = (F.lag, F.max_by) if kind == "lag" else (F.lead, F.min_by)
            local[here] = step(boxed).over(inside)
            totals.append(edge(boxed, at).alias(total))
            carried.append(step(total).over(before).alias(carry))
            merged[name] = F.coalesce(F.col(here), F.col(carry))["v"]
        else:
            raise ValueError(f"unknown kind {kind!r}")
        if kind in ("last", "before"):
            totals.append(F.max_by(value, F.when(value.isNotNull(), at)).alias(total))
            carried.append(F.last(total, ignorenulls=True).over(earlier).alias(carry))
            merged[name] = F.coalesce(F.col(here), F.col(carry))

    summary = rows.groupBy(*part).agg(*totals).select(*part, *carried)
    resets = [n for n, v in specs.items() if v[0] == "since"]
    for n in resets:
        summary = summary.withColumn(f"_k_{n}", F.last(f"_b_{n}", ignorenulls=True).over(earlier)).drop(f"_b_{n}")
    joined = rows.withColumns(local).join(summary, part, "left")
    return joined.select(*df.columns, *[c.alias(n) for n, c in merged.items()])


def numbered(df: DataFrame, key: list[str], order: list[str], block: Column, name: str) -> DataFrame:
    """0-based row number per key."""
    out = running(df, key, order, block, **{name: ("sum", F.lit(1).cast("bigint"))})
    return out.withColumn(name, F.col(name) - F.lit(1))


def carry_in_sessions(
    df: DataFrame, key: list[str], order: list[str], at: Column, gap: int, block: Column,
    session: str, values: dict[str, Column],
) -> DataFrame:
    """Number the sessions of each key and carry values forward inside them.

    A row more than ``gap`` after the one before (``at``, a number) opens a
    session; values from before it are forgotten. Whether the first row of a
    block opens one is only known between blocks, so it is settled on the
    block summaries, and one join brings everything back.
    """
    part = [*key, BLOCK]
    inside = Window.partitionBy(*part).orderBy(*order)
    up_to = inside.rowsBetween(Window.unboundedPreceding, 0)
    blocks = Window.partitionBy(*key).orderBy(BLOCK)
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    zero, place = F.lit(0).cast("bigint"), F.struct(*order)

    rows = cut_dense(df.withColumns({BLOCK: block, "_at": at}), key, order[0])
    step = F.col("_at") - F.lag("_at").over(inside)
    rows = rows.withColumn("_new", F.coalesce(step > gap, F.lit(False)))
    stamped = {n: F.when(v.isNotNull(), F.struct(F.col("_at").alias("at"), v.alias("v"))) for n, v in values.items()}

    summary = rows.groupBy(*part).agg(
        F.count_if("_new").alias("_n"), F.max(F.when(F.col("_new"), F.col("_at"))).alias("_since"),
        F.min("_at").alias("_first"), F.max("_at").alias("_last"),
        *[F.max_by(v, F.when(v.isNotNull(), place)).alias(f"_t_{n}") for n, v in stamped.items()],
    )
    step = F.col("_first") - F.lag("_last").over(blocks)
    summary = summary.withColumn("_opens", F.coalesce(step > gap, F.lit(True)))
    opens = F.col("_opens").cast("bigint")
    started = F.coalesce("_since", F.when(F.col("_opens"), F.col("_first")))
    summary = summary.select(
        *part,
        (F.coalesce(F.sum(F.col("_n") + opens).over(earlier), zero) + opens).alias("_c_n"),
        F.coalesce(F.when(F.col("_opens"), F.col("_first")), F.last(started, ignorenulls=True).over(earlier)).alias("_c_since"),
        *[F.last(f"_t_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in values],
    )
    local = {
        "_l_n": F.count_if("_new").over(up_to),
        "_l_since": F.last(F.when(F.col("_new"), F.col("_at")), ignorenulls=True).over(up_to),
        **{f"_l_{n}": F.last(v, ignorenulls=True).over(up_to) for n, v in stamped.items()},
    }
    joined = rows.withColumns(local).join(summary, part, "left")
    since = F.coalesce("_l_since", "_c_since")
    newest = {n: F.coalesce(f"_l_{n}", f"_c_{n}") for n in values}
    return joined.select(
        *[c for c in df.columns if c not in values],
        (F.col("_l_n") + F.col("_c_n")).alias(session),
        *[F.when(v["at"] >= since, v["v"]).alias(n) for n, v in newest.items()],
    )
