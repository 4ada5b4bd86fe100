"""Presets, tuning history and request checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aetherlog import dims
from aetherlog.plans.blocked import running, time_block


# --- presets -----------------------------------------------------------------------------

def with_preset(df: DataFrame, presets: DataFrame) -> DataFrame:
    """Look a preset up by id; an unknown id keeps the row and says so.

    No broadcast hint: Spark broadcasts the dimension itself while its size
    is below the threshold.
    """
    p = presets.select(F.col("id").alias("preset_id"), "freq", "label", "category", F.lit(True).alias("_known"))
    return df.join(p, "preset_id", "left").withColumn(
        "error", F.when(F.col("_known").isNull(), "Unknown preset")).drop("_known")


def available_presets(p: DataFrame, mode: str) -> DataFrame:
    """Presets usable in a mode: web streams need a stream URL."""
    has_url = F.coalesce(F.length("stream_url"), F.lit(0)) > 0
    return p.filter(has_url) if mode == "WEBSTREAM" else p


def presets_in(p: DataFrame, category: str) -> DataFrame:
    return p.filter(F.col("category") == category)


def presets_by_category(p: DataFrame, categories: DataFrame) -> DataFrame:
    """Every category in display order with its presets, empty ones included."""
    listed = categories.join(p.select("category", "id", "label"), "category", "left")
    item = F.when(F.col("id").isNotNull(), F.struct("id", p["label"].alias("preset_label")))
    return listed.groupBy("category", "ord", "category_label").agg(
        F.sort_array(F.collect_list(item)).alias("presets"))


# --- tuner settings ------------------------------------------------------------------------

def effective_tuning(status: DataFrame) -> DataFrame:
    """Sample rate, de-emphasis and squelch after defaults and limits."""
    mode = F.coalesce(F.nullif(F.col("mode"), F.lit("")), F.lit("fm"))
    rates = F.create_map(*[F.lit(x) for kv in dims.MODE_SAMPLE_RATES.items() for x in kv])
    return status.withColumns({
        "effective_sample_rate": F.coalesce(
            F.nullif(F.col("sample_rate"), F.lit("")), F.try_element_at(rates, mode), F.lit(dims.DEFAULT_SAMPLE_RATE)),
        "effective_deemp": F.coalesce(
            "deemp", F.coalesce(F.col("mode").isin(dims.DEEMPHASIS_MODES), F.lit(False))),
        "effective_squelch": F.greatest(F.lit(0), F.least(F.lit(100), "squelch")),
    })


def view_rules(status: DataFrame, presets: DataFrame) -> DataFrame:
    """Which panels a tuned preset shows."""
    p = presets.select(F.col("id").alias("preset_id"), "category", F.col("mode").alias("preset_mode"))
    aviation = F.coalesce(F.col("category") == "aviation", F.lit(False))
    weather = F.coalesce(F.col("category") == "weather", F.lit(False))
    map_on = F.coalesce("adsb_enabled", F.lit(False)) & aviation
    only_map = map_on & F.coalesce(F.col("preset_mode") == "adsb", F.lit(False))
    return status.join(p, "preset_id", "left").withColumns({
        "map_panel": F.when(only_map, "full").when(map_on, "shown").otherwise("hidden"),
        "transcript_visible": ~only_map,
        "weather_panel": weather,
        "satellite_panel": weather,
        "correlation": map_on & ~only_map,
    })


def validate_requests(
    req: DataFrame, presets: DataFrame, locks: DataFrame, mode: str = "SDR", block_s: int = 3600,
) -> DataFrame:
    """Reason code of each tune request; equal requests each get one.

    ``locks`` are satellite recordings ``(station, lock_start, lock_end)``. A request is locked if the latest end of
    all recordings begun so far lies behind it: a running maximum over both tables, not a join.
    """
    p = presets.select(
        F.col("id").alias("preset_id"), F.lit(True).alias("_known"),
        (F.coalesce(F.length("stream_url"), F.lit(0)) > 0).alias("_url"))
    none = F.lit(None)
    asked = req.select("station", "ts", F.lit(1).alias("_side"), none.cast("timestamp").alias("_end"), F.struct(*req.columns).alias("_req"))
    held = locks.select("station", F.col("lock_start").alias("ts"), F.lit(0).alias("_side"), F.col("lock_end").alias("_end"),
                        none.cast(asked.schema["_req"].dataType).alias("_req"))
    walked = running(held.unionByName(asked), ["station"], ["ts", "_side"], time_block("ts", block_s), _until=("max", F.col("_end")))
    per = walked.filter(F.col("_side") == 1).select("_req.*", F.coalesce(F.col("_until") > F.col("ts"), F.lit(False)).alias("_locked"))
    no_stream = F.lit(mode == "WEBSTREAM") & ~F.col("_url")
    return per.join(p, "preset_id", "left").withColumn(
        "reason",
        F.when(F.col("_known").isNull(), "unknown_preset")
        .when(no_stream, "no_web_stream")
        .when(F.col("_locked"), "locked").otherwise("ok")).drop("_known", "_url", "_locked")


# --- tuning history ---------------------------------------------------------------------------

def tuning_sessions(events: DataFrame, key: list[str] = ["station"], order: list[str] = ["ts", "seq"], block_s: int = 3600) -> DataFrame:
    """Sessions from ``tune``, ``stop``, ``apt_enter`` and ``apt_exit`` events.

    Tune and stop have no lasting effect while a satellite is recorded; the
    preset in force before comes back afterwards.
    """
    kind, blk = F.col("kind"), time_block("ts", block_s)
    switch = kind.isin("apt_enter", "apt_exit")
    known = events.filter(switch | kind.isin("tune", "stop"))
    entered = F.when(switch, kind == "apt_enter")
    modes = running(known, key, order, blk, _apt=("last", entered), _was=("before", entered))
    apt = F.coalesce("_apt", F.lit(False))
    chosen = F.when(~switch & ~apt, F.struct(F.when(kind == "tune", F.col("preset_id")).alias("id")))
    state = running(modes.withColumn("_apt", apt), key, order, blk, _base=("last", chosen))
    was = F.coalesce("_was", F.lit(False))
    changes = state.filter(F.when(switch, F.col("_apt") != was).otherwise(~F.col("_apt")))
    ends = running(changes, key, order, blk, end_ts=("lead", F.col("ts")))
    preset = F.when(~F.col("_apt"), F.col("_base.id"))
    return ends.select(
        *key, F.col("ts").alias("start_ts"), "end_ts", preset.alias("preset_id"),
        F.col("_apt").alias("satellite_mode"),
    ).filter(F.col("satellite_mode") | F.col("preset_id").isNotNull())


def preset_as_of(
    segments: DataFrame, tune_events: DataFrame, key: list[str] = ["station"], block_s: int = 3600,
) -> DataFrame:
    """The preset in force at each segment: one ordered pass over both tables.

    ``segments`` has ``(key, ts, seq)``; ``tune_events`` has ``(key, ts, seq, preset_id)``
    with NULL for a stop. A tune counts for segments of the same instant.
    """
    none = F.lit(None)
    left = segments.select(
        *key, "ts", "seq", F.lit(1).alias("_side"), none.cast("struct<id:string>").alias("_p"),
        F.struct(*[c for c in segments.columns if c not in (*key, "ts", "seq")], "ts").alias("_row"))
    right = tune_events.select(
        *key, "ts", "seq", F.lit(0).alias("_side"), F.struct(F.col("preset_id").alias("id")).alias("_p"),
        none.cast(left.schema["_row"].dataType).alias("_row"))
    filled = running(
        left.unionByName(right), key, ["ts", "_side", "seq"], time_block("ts", block_s), _now=("last", F.col("_p")))
    rest = [F.col("_row")[c].alias(c) for c in segments.columns if c not in (*key, "ts", "seq")]
    return filled.filter(F.col("_side") == 1).select(*key, "ts", "seq", *rest, F.col("_now.id").alias("preset_id"))
