"""Registered queries: audio, frames and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from aetherlog.functions import display as D
from aetherlog.operators import signal as S
from aetherlog.plans.registry import query
from aetherlog.session import shared_folder
from aetherlog.sources import readers, recordings

SILENCE, SIGNAL, QUIET = 35.0, 45.0, 10.0

# Chunks of the document bytes, and their samples as signed 16-bit integers.
_CHUNKS = """WITH recordings AS (SELECT doc_id AS stream_id, hex(encode(text)) AS h, strlen(text) AS len FROM documents),
chunks AS (SELECT stream_id, seq, substr(h, CAST(seq * 8192 + 1 AS BIGINT), 8192) AS h
    FROM (SELECT *, unnest(range(0, (len + 4095) // 4096)) AS seq FROM recordings))"""
_SAMPLES = _CHUNKS + """, samples AS (SELECT stream_id, seq, i, CASE WHEN u >= 32768 THEN u - 65536 ELSE u END AS x
    FROM (SELECT stream_id, seq, i, CAST('0x' || substr(h, CAST(i * 4 + 3 AS BIGINT), 2) || substr(h, CAST(i * 4 + 1 AS BIGINT), 2) AS BIGINT) AS u
          FROM (SELECT *, unnest(range(0, length(h) // 4)) AS i FROM chunks)))"""

_FRAMES = _SAMPLES + """, pcm_frames AS (SELECT stream_id, (seq * 2048 + i) // 1600 AS frame_idx, CAST(count(*) AS INTEGER) AS n,
    CAST(sum(x * x) AS DOUBLE) AS sumsq FROM samples GROUP BY 1, 2 HAVING count(*) = 1600)"""


def _chunks(t):
    return readers.pcm_chunks(t.recordings())


# Recordings as files: the documents' bytes one after the other, a hundred a file.
_FILES = """WITH recordings AS (SELECT doc_id // 100 AS stream_id, string_agg(text, '' ORDER BY doc_id) AS body FROM documents GROUP BY 1),
chunks AS (SELECT stream_id, seq, substr(h, CAST(seq * 8192 + 1 AS BIGINT), 8192) AS h
    FROM (SELECT stream_id, hex(encode(body)) AS h, unnest(range(0, (strlen(body) + 4095) // 4096)) AS seq FROM recordings))"""


def _recordings(t):
    texts = t.read("documents").groupBy(F.floor(F.col("doc_id") / 100).cast("bigint").alias("stream_id")).agg(
        F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("d"))
    return texts.select("stream_id", F.encode(F.array_join("d.text", ""), "UTF-8").alias("content"))


@query("src_1_pcm_chunks", sql=_FILES + " SELECT stream_id, seq, length(h) // 2 AS bytes, md5(h) AS digest FROM chunks")
def _(t):
    """Written as recordings and read back, each by several tasks."""
    path = shared_folder(t.spark, "recordings")
    recordings.write_recordings(_recordings(t), path)
    chunks = readers.read_pcm(t.spark, path, block_bytes=1 << 17)
    return chunks.select(F.regexp_extract("stream_id", r"([0-9]+)\.raw$", 1).cast("bigint").alias("stream_id"), "seq",
                         F.length("pcm").cast("bigint").alias("bytes"), F.md5(F.hex("pcm").cast("binary")).alias("digest"))


@query("agg_1_frame_energy", sql=_FRAMES + " SELECT stream_id, frame_idx, n, sumsq, round(sqrt(sumsq / n), 4) AS rms FROM pcm_frames")
def _(t):
    return S.frames(_chunks(t)).withColumn("rms", F.round("rms", 4))


@query("agg_2_signal_levels", sql=_SAMPLES + """ SELECT stream_id, seq, round(sqrt(CAST(sum(x * x) AS DOUBLE) / 2048), 1) AS level
    FROM samples GROUP BY 1, 2 HAVING count(*) = 2048""")
def _(t):
    return S.signal_levels(_chunks(t)).select("stream_id", "seq", "level")


@query("flt_9_meterable_chunks", sql=_CHUNKS + " SELECT stream_id, count(*) AS chunks FROM chunks WHERE length(h) >= 8192 GROUP BY 1")
def _(t):
    return _chunks(t).filter(F.length("pcm") >= 4096).groupBy("stream_id").agg(F.count(F.lit(1)).alias("chunks"))


_RUNS = """, runs AS (SELECT *, frame_idx - coalesce(max(CASE WHEN rms >= {thr} THEN frame_idx END)
    OVER (PARTITION BY stream_id ORDER BY frame_idx), -1) AS silence_run FROM frames)"""
_CUTS = _RUNS + """, cuts AS (SELECT stream_id, frame_idx, CASE WHEN q <= frame_idx + 149 THEN q + 1
    WHEN frame_idx + 149 <= top THEN frame_idx + 150 END AS nxt FROM (SELECT *,
    min(CASE WHEN silence_run >= 3 THEN frame_idx END) OVER (PARTITION BY stream_id ORDER BY frame_idx ROWS BETWEEN 9 FOLLOWING AND 149 FOLLOWING) AS q,
    max(frame_idx) OVER (PARTITION BY stream_id) AS top FROM runs)),
chain AS (SELECT stream_id, frame_idx, nxt FROM cuts WHERE frame_idx = 0
    UNION ALL SELECT c.stream_id, c.frame_idx, c.nxt FROM chain p JOIN cuts c ON c.stream_id = p.stream_id AND c.frame_idx = p.nxt),
segments AS (SELECT stream_id, frame_idx AS start_idx, nxt - 1 AS end_idx FROM chain WHERE nxt IS NOT NULL)"""


def _cuts_sql(threshold: float) -> str:
    return "/*RECURSIVE*/" + _CUTS.replace("{thr}", str(threshold))


@query("win_1_silence_runs", "frames", sql=_RUNS.replace("{thr}", str(SILENCE)) + " SELECT stream_id, frame_idx, silence_run FROM runs")
def _(t):
    return S.silence_runs(t.frames(), threshold=SILENCE).select("stream_id", "frame_idx", "silence_run")


@query("win_2_vad_segments", "frames", sql=_cuts_sql(SILENCE) + " SELECT * FROM segments")
def _(t):
    return S.vad_segments(t.frames(), threshold=SILENCE)


@query("win_2_vad_forced_split", "frames", sql=_cuts_sql(QUIET) + " SELECT * FROM segments")
def _(t):
    return S.vad_segments(t.frames(), threshold=QUIET)


_FIXED = """, fixed AS (SELECT stream_id, seg_no, seg_no * 280 AS start_idx, seg_no * 280 + 299 AS end_idx, round(sqrt(sum(sumsq) / sum(n)), 3) AS rms
    FROM (SELECT *, unnest(range(greatest(0, CAST(floor((frame_idx - 300) / 280) AS BIGINT) + 1), frame_idx // 280 + 1)) AS seg_no FROM frames)
    GROUP BY 1, 2 HAVING count(*) = 300)"""


@query("win_3_fixed_segments", "frames", sql=_FIXED + " SELECT * FROM fixed")
def _(t):
    return S.fixed_segments(t.frames()).withColumn("rms", F.round("rms", 3))


_STATS = """, stats AS (SELECT s.stream_id, start_idx, end_idx, sqrt(sum(f.sumsq) / sum(f.n)) AS rms, sum(f.n) / 16000 AS audio_s
    FROM segments s JOIN frames f ON f.stream_id = s.stream_id AND f.frame_idx BETWEEN start_idx AND end_idx GROUP BY 1, 2, 3)"""


@query("win_4_segment_stats", "frames", sql=_cuts_sql(SILENCE) + _STATS + " SELECT stream_id, start_idx, end_idx, round(rms, 3) AS rms, round(audio_s, 3) AS audio_s FROM stats")
def _(t):
    f = t.frames()
    return S.segment_stats(f, S.vad_segments(f, threshold=SILENCE)).select(
        "stream_id", "start_idx", "end_idx", F.round("rms", 3).alias("rms"), F.round("audio_s", 3).alias("audio_s"))


@query("flt_1_signal_segments", "frames", sql=_cuts_sql(SILENCE) + _STATS + f" SELECT stream_id, start_idx, end_idx, round(rms, 3) AS rms FROM stats WHERE rms > {SIGNAL}")
def _(t):
    f = t.frames()
    return S.filter_signal(S.segment_stats(f, S.vad_segments(f, threshold=SILENCE)), SIGNAL).select(
        "stream_id", "start_idx", "end_idx", F.round("rms", 3).alias("rms"))


@query("prj_9_segment_mode", "status", "presets", sql="""SELECT segment_mode, parser, count(*) AS n FROM (
    SELECT p.parser, CASE WHEN p.parser = 'noaa' AND coalesce(p.squelch, -1) = 0 THEN 'fixed' ELSE 'vad' END AS segment_mode
    FROM status s JOIN presets p ON p.id = s.preset_id) GROUP BY 1, 2""")
def _(t):
    modes = S.segment_mode(t.presets()).select(F.col("id").alias("preset_id"), "parser", "segment_mode")
    return t.status().join(modes, "preset_id").groupBy("segment_mode", "parser").agg(F.count(F.lit(1)).alias("n"))


@query("sc_9_meter", "ev", sql="""SELECT seq, round(least(100.0, value * 40 / 10000 * 100), 3) AS pct, CASE WHEN least(100.0, value * 40 / 10000.0 * 100.0) < 30 THEN 'low'
    WHEN least(100.0, value * 40 / 10000.0 * 100.0) < 70 THEN 'mid' ELSE 'high' END AS band FROM ev""")
def _(t):
    pct = D.meter_pct(F.col("value") * 40)
    return t.events().select("seq", F.round(pct, 3).alias("pct"), D.meter_band(pct).alias("band"))


@query("udf_1_transcribe", sql=_FRAMES + """
    SELECT stream_id, frame_idx AS start_idx, substr(md5(substr(h, CAST(frame_idx * 6400 + 1 AS BIGINT), 6400)), 1, 12) AS text
    FROM pcm_frames JOIN recordings USING (stream_id)""")
def _(t):
    """A stand-in backend that names each one-frame segment by a digest of its audio."""
    import hashlib

    chunks = _chunks(t)
    spans = S.frames(chunks).select("stream_id", F.col("frame_idx").alias("start_idx"), F.col("frame_idx").alias("end_idx"))

    def backend():
        return lambda audio: [hashlib.md5(a.hex().upper().encode()).hexdigest()[:12] for a in audio]

    return S.transcribe(S.segment_audio(chunks, spans), backend).select("stream_id", "start_idx", "text")


@query("udf_1_fallback", sql=_FRAMES + """
    SELECT stream_id, frame_idx AS start_idx, substr(md5(substr(h, CAST(frame_idx * 6400 + 1 AS BIGINT), 6400 * k)), 1, 12) AS text, CASE WHEN k > 1 THEN 'cpu' ELSE 'npu' END AS backend
    FROM (SELECT stream_id, frame_idx, 1 + frame_idx % 3 AS k, max(frame_idx) OVER (PARTITION BY stream_id) AS top FROM pcm_frames) JOIN recordings USING (stream_id) WHERE frame_idx + k - 1 <= top""")
def _(t):
    """One backend that is not there, one that fails on batches of more than one frame, and one that takes what they leave."""
    import hashlib

    chunks = _chunks(t)
    frames = S.frames(chunks)
    top = frames.groupBy("stream_id").agg(F.max("frame_idx").alias("top"))
    spans = frames.join(top, "stream_id").withColumn("end_idx", F.col("frame_idx") + F.col("frame_idx") % 3).filter("end_idx <= top").select(
        "stream_id", F.col("frame_idx").alias("start_idx"), "end_idx")

    def digests(audio):
        return [hashlib.md5(a.hex().upper().encode()).hexdigest()[:12] for a in audio]

    def missing():
        raise OSError("no such device")

    def short_only():
        def fn(audio):
            if max(map(len, audio)) > 3200:
                raise ValueError("segment too long")
            return digests(audio)
        return fn

    out = S.transcribe_with(S.segment_audio(chunks, spans), [("gpu", missing), ("npu", short_only), ("cpu", lambda: digests)], bucket_s=0.101)
    return out.select("stream_id", "start_idx", "text", "backend")


@query("udf_5_frame_energy_parts", sql=_SAMPLES + """ SELECT stream_id, seq, (seq * 2048 + i) // 1600 AS frame_idx, count(*) AS n, CAST(sum(x * x) AS DOUBLE) AS sumsq
    FROM samples GROUP BY 1, 2, 3""")
def _(t):
    return S.frame_parts(_chunks(t))
