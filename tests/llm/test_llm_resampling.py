"""Resampling towards a target: against a plain version, on transcripts as their reader returns them and on odd rows."""

import hashlib
import math
import random
import re
import zlib

import corpus as c
import numpy as np
import pyarrow as pa
import pytest

from aetherlog import schemas
from aetherlog.llm import resampling as R
from aetherlog.sources import readers

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, run):
    w = WORD.findall(c.lower(text or "").encode())
    return w, [b" ".join(w[i:i + k]) for k in range(1, run + 1) for i in range(len(w) - k + 1)]


def plain(rows, references, run=1, percent=10, least=20, buckets=10000, seed="2024"):
    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for g in grams(t, run)[1]:
                out[zlib.crc32(g) % buckets] += 1
        return out
    s, t = counts([r[1] for r in rows]), counts(references)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for key, text in rows:
        w, g = grams(text, run)
        weight = sum(gain[zlib.crc32(x) % buckets] for x in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(w), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for n, r in enumerate(able[:percent * len(able) // 100]):
        r[5] = n + 1
    return sorted(map(tuple, out), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def heard(spark, tmp_path_factory):
    """Transcripts written and read back by the library's reader, references, and the rows."""
    rng = random.Random(4)
    rows = [(r[0], r[1]) for r in c.rows(8, 40)]
    rows += [(500 + i, " ".join(rng.choice(["Wind", "southwest", "fünfzehn", "KNOTS", "gale-warning", "x1", "seas"]) for _ in range(20 + i))) for i in range(60)]
    path = str(tmp_path_factory.mktemp("heard") / "t")
    spark.createDataFrame([(i, "tower", None, None, None, None, "en", t, 1.0) for i, t in rows], schemas.TRANSCRIPTS).repartition(4).write.parquet(path)
    references = ["wind southwest fünfzehn knots", "gale warning seas", None, ""]
    return readers.transcripts(spark, path), spark.createDataFrame([(i, t) for i, t in enumerate(references)], "reference_id INT, text STRING"), rows, references


@pytest.mark.parametrize("run, percent, least", [(1, 10, 20), (2, 35, 5), (3, 100, 0)])
def test_resample_equals_plain_version(heard, run, percent, least):
    df, refs, rows, texts = heard
    out = got(R.resample(df, refs, run=run, percent=percent, min_words=least))
    assert out == plain(rows, texts, run, percent, least)
    assert sum(r[5] is not None for r in out) > 5


def test_resample_odd_rows(spark, heard):
    _, refs, _, texts = heard
    rows = [(None, "wind " * 30), (None, "wind " * 30), (3, None), (3, ""), (4, "--- ..."), (5, "seas " * 25), (5, "seas " * 25), (7, "é" * 5000 + " a " + "9" * 3000)]
    df = spark.createDataFrame([(*r, "n") for r in rows], "transcript_id BIGINT, text STRING, score STRING")
    assert got(R.resample(df, refs, percent=60)) == plain(rows, texts, percent=60)
    assert R.resample(df.limit(0), refs).count() == 0
    none = refs.limit(0)
    assert got(R.resample(df, none, percent=50)) == plain(rows, [], percent=50)


def test_long_texts_are_cut_between_words(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcé") for _ in range(rng.choice([1, 3, 9, 1100]))) for _ in range(rng.randrange(1, 60))) for _ in range(12)] + [None, "", "ab"]
    for piece, run in ((64, 1), (3000, 3), (1 << 19, 3)):
        monkeypatch.setattr(R, "PIECE", piece)
        found = {i: [] for i in range(len(texts))}
        words = np.zeros(len(texts), int)
        for own, row, bucket in R.features(pa.array(texts), 1 << 32, run):
            np.add.at(words, own, 1)
            for r, b in zip(row.tolist(), bucket.tolist()):
                found[r].append(b)
        for i, t in enumerate(texts):
            w, g = grams(t, run)
            assert words[i] == len(w) and sorted(found[i]) == sorted(zlib.crc32(x) for x in g)


def test_payloads_compose():
    rng = random.Random(1)
    a, b = ([rng.randbytes(rng.randrange(0, 300)) for _ in range(50)] for _ in range(2))
    load = lambda xs: np.array([len(x) << 32 | zlib.crc32(x) for x in xs], np.int64)
    assert (R.compose(load(a), load(b)) == load([x + y for x, y in zip(a, b)])).all()
    end, payload = R.scan(b" one two  one ab ")
    assert end.tolist() == [4, 8, 13, 16] and payload.tolist() == load([b"one", b"two", b"one", b"ab"]).tolist()


def test_gains_prefer_the_target():
    gains = R.bucket_gains(np.array([100, 10, 0, 5]), np.array([0, 10, 5, 0]))
    assert gains[2] > gains[1] > gains[3] > gains[0]
