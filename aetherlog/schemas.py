"""Declared schemas; nothing is inferred at run time."""

PCM_CHUNKS = "stream_id STRING, seq BIGINT, ts TIMESTAMP, pcm BINARY"
FRAMES = "stream_id STRING, frame_idx BIGINT, n INT, sumsq DOUBLE, rms DOUBLE"
SEGMENTS = "stream_id STRING, start_idx BIGINT, end_idx BIGINT"
TRANSCRIPTS = (
    "transcript_id BIGINT, stream_id STRING, ts TIMESTAMP, preset_id STRING, freq STRING, label STRING, language STRING, "
    "text STRING, rms DOUBLE"
)
SBS_LINES = "value STRING, ts TIMESTAMP, seq BIGINT"
UPDATES = (
    "hex STRING, ts TIMESTAMP, seq BIGINT, flight STRING, altitude INT, speed DOUBLE, track DOUBLE, "
    "lat DOUBLE, lon DOUBLE, vert_rate INT, squawk STRING"
)
PRESETS = (
    "id STRING, label STRING, freq STRING, mode STRING, category STRING, squelch INT, parser STRING, "
    "stream_url STRING, device_index INT"
)
CATEGORIES = "category STRING, ord INT, category_label STRING"
PASSES = (
    "satellite STRING, frequency STRING, aos TIMESTAMP, los TIMESTAMP, max_elevation DOUBLE, duration_s BIGINT"
)
LOOK_ANGLES = "satellite STRING, ts TIMESTAMP, elevation DOUBLE"
TICKS = "tick TIMESTAMP"
STATUS = (
    "station STRING, ts TIMESTAMP, seq BIGINT, running BOOLEAN, sdr_connected BOOLEAN, preset_id STRING, "
    "mode STRING, squelch INT, gain STRING, sample_rate STRING, deemp BOOLEAN"
)
INFERENCE_LOG = (
    "stream_id STRING, ts TIMESTAMP, seq BIGINT, skipped BOOLEAN, tokens INT, encoder_ms DOUBLE, "
    "decoder_ms DOUBLE, audio_s DOUBLE, backend STRING"
)
HEALTH = "station STRING, ts TIMESTAMP, seq BIGINT, kind STRING"
TUNE_EVENTS = "station STRING, ts TIMESTAMP, seq BIGINT, kind STRING, preset_id STRING"
BINARY_FILE = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
EVENTS = "event STRING, key STRING, ts TIMESTAMP, payload STRING"
ALERT = "type STRING, name STRING, area STRING"
