"""Following a chain of jumps through a long ordered series.

Every row has a position and the position from which the next choice may be
made; the chain takes the first row, then the first row at or after that
row's ``nxt``, and so on. Voice-activity cuts and non-overlapping recordings
are both such chains. The choice at one row depends on all before it, yet one
series may hold a third of all rows, so it is never walked in one task:

1. every block of positions is reduced to a step function "threshold coming
   in -> threshold going out". A jump is at most ``jump`` long, so only the
   rows within ``jump`` of the block start can be entered;
2. the step functions of ``FAN_IN`` consecutive blocks are composed into one;
3. per series the composed functions give the threshold entering each group;
4. inside the groups, then inside the blocks, the rows on the chain are read off.

All thresholds are 64-bit integers; ``END`` means the chain has ended.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = 2**62
FAN_IN = 1024


def _through(b, e, x):
    """Apply the step function (e, x) to thresholds b."""
    b = np.asarray(b)
    return np.where(b >= END, END, np.asarray(x)[np.searchsorted(e, b)])


def _squeeze(e, x):
    """Keep one entry per run of equal exits."""
    keep = np.append(x[1:] != x[:-1], True)
    return e[keep], x[keep]


def _leads_to(pos, nxt):
    """Index of the row each row leads to; its own index where it leaves the block."""
    to = np.searchsorted(pos, nxt)
    own = np.arange(len(pos))
    return np.where(to < len(pos), to, own), own


def _block_map(pos, nxt, start, span, jump):
    """Step function of one block."""
    to, own = _leads_to(pos, nxt)
    while not np.array_equal(to[to], to):
        to = to[to]
    out = np.maximum(nxt, start + span)[to]
    n = np.searchsorted(pos, start + jump) + 1
    return _squeeze(np.append(pos[:n], END), np.append(out[:n], start + span))


def _on_chain(pos, nxt, entry):
    """Indices of the rows of one block the chain visits."""
    if entry >= END:
        return []
    to, _ = _leads_to(pos, nxt)
    at, seen = int(np.searchsorted(pos, entry)), []
    while at < len(pos):
        seen.append(at)
        at = int(to[at]) if to[at] != at else len(pos)
    return seen


def follow_chain(df: DataFrame, key: list[str], pos: str, nxt: str, jump: int, span: int) -> DataFrame:
    """Rows ``(key, pos, nxt)`` on the chain; ``nxt`` NULL ends the chain after the row.

    ``pos`` must be unique per key and ``0 < nxt - pos <= jump <= span``. ``span``
    sets how many positions one block covers and so bounds the rows per task.
    """
    if jump > span:
        raise ValueError("span must be at least jump")
    names = [f"k{i}" for i in range(len(key))]
    rows = df.select(
        *[F.col(k).alias(n) for k, n in zip(key, names)],
        F.col(pos).cast("bigint").alias("p"),
        F.coalesce(F.col(nxt).cast("bigint"), F.lit(END)).alias("n"),
    )
    key_ddl = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    cells = (
        rows.withColumn("blk", F.floor(F.col("p") / F.lit(span)).cast("bigint"))
        .groupBy(*names, "blk")
        .agg(F.sort_array(F.collect_list(F.struct("p", "n"))).alias("r"))
        .select(*names, "blk", F.floor(F.col("blk") / F.lit(FAN_IN)).cast("bigint").alias("grp"),
                F.col("r.p").alias("ps"), F.col("r.n").alias("ns"))
    )

    @F.pandas_udf("struct<e:array<bigint>,x:array<bigint>>")
    def block_map(blk: pd.Series, ps: pd.Series, ns: pd.Series) -> pd.DataFrame:
        maps = [_block_map(p, n, b * span, span, jump) for b, p, n in zip(blk, ps, ns)]
        return pd.DataFrame({"e": [m[0] for m in maps], "x": [m[1] for m in maps]})

    @F.pandas_udf("array<int>")
    def on_chain(ps: pd.Series, ns: pd.Series, entry: pd.Series) -> pd.Series:
        return pd.Series([_on_chain(p, n, b) for p, n, b in zip(ps, ns, entry)])

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blk")
        e, x = pdf["e"].iloc[0], pdf["x"].iloc[0]
        for e2, x2 in zip(pdf["e"].iloc[1:], pdf["x"].iloc[1:]):
            x = _through(x, e2, x2)
        e, x = _squeeze(np.asarray(e), np.asarray(x))
        return pdf.iloc[:1].assign(e=[e], x=[x])[[*names, "grp", "e", "x"]]

    def entries(unit: str):
        """Threshold entering each unit, given the one entering the first."""

        def walk(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(unit)
            b, came_in = pdf["entry"].iloc[0], []
            for e, x in zip(pdf["e"], pdf["x"]):
                came_in.append(b)
                b = int(_through(b, e, x))
            return pdf.assign(entry=came_in)[[*names, unit, "entry"]]

        return walk

    maps = (
        cells.withColumn("m", block_map("blk", "ps", "ns"))
        .select(*names, "blk", "grp", "m.e", "m.x")
    )
    per_group = (
        maps.groupBy(*names, "grp")
        .applyInPandas(compose, f"{key_ddl}, grp bigint, e array<bigint>, x array<bigint>")
    )
    group_entry = (
        per_group.withColumn("entry", F.lit(-END).cast("bigint"))
        .groupBy(*names)
        .applyInPandas(entries("grp"), f"{key_ddl}, grp bigint, entry bigint")
    )
    block_entry = (
        maps.join(group_entry, [*names, "grp"])
        .groupBy(*names, "grp")
        .applyInPandas(entries("blk"), f"{key_ddl}, blk bigint, entry bigint")
    )
    hits = cells.join(block_entry, [*names, "blk"]).withColumn("hit", on_chain("ps", "ns", "entry"))
    taken = hits.select(*names, F.explode(F.expr("transform(hit, i -> struct(ps[i] AS p, ns[i] AS n))")).alias("t"))
    return taken.select(
        *[F.col(n).alias(k) for k, n in zip(key, names)],
        F.col("t.p").alias(pos),
        F.when(F.col("t.n") < F.lit(END), F.col("t.n")).alias(nxt),
    )
