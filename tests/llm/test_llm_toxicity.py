"""Abuse: the matcher against plain edit distances, and held-out accuracy on transcripts with planted abuse."""

import random
import zlib

import corpus as c
import numpy as np
import pyarrow as pa
import pytest

from aetherlog import schemas
from aetherlog.llm import toxicity as X
from aetherlog.sources import readers

TERMS = ("idiot", "stupid", "worthless", "scum", "disgusting", "loser", "closer", "pfuigeist")
STEMS = ("lowei", "vequ", "idi", "sch")
LEXICON = X.Lexicon((*((t, False, 5.0 + i) for i, t in enumerate(TERMS)), *((s, True, 4.0 + i) for i, s in enumerate(STEMS))))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def plain(word):
    found = [(d, False, -w, i) for i, (t, stem, w) in enumerate(LEXICON.entries) if not stem and (d := distance(t, word)) <= X._budget(t)]
    found += [(0, True, -w, i) for i, (t, stem, w) in enumerate(LEXICON.entries) if stem and word.startswith(t)]
    return min(found, default=None)


def test_matcher_equals_plain_distances():
    rng = random.Random(7)
    said = []
    for _ in range(4000):
        w = list(rng.choice((*TERMS, *STEMS, "other", "wind")))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w) + 1)
            kind = rng.randrange(3)
            if kind == 0:
                w.insert(i, rng.choice("abiotsé"))
            elif i < len(w):
                if kind == 1:
                    del w[i]
                else:
                    w[i] = rng.choice("abiotsé")
        said.append("".join(w) or "x")
    points = np.array([ord(ch) for w in said for ch in w])
    ends = np.cumsum([len(w) for w in said])
    matcher = X.Matcher(LEXICON)
    entry, edits = matcher.run(points, ends - [len(w) for w in said], ends)
    for w, i, e in zip(said, entry.tolist(), edits.tolist()):
        want = plain(w)
        assert (i, e) == ((-1, 0) if want is None else (want[3], want[0])), w
    assert (edits > 0).sum() > 500 and (entry < 0).sum() > 200
    again, _ = matcher.run(points, ends - [len(w) for w in said], ends)  # with every transition known
    assert (again == entry).all()


def test_words_and_windows():
    points, starts, ends, first = X.words(["Über-Idiot! l0ser", "", "a\nb"])
    assert ["".join(map(chr, points[s:e])) for s, e in zip(starts, ends)] == ["über", "idiot", "l0ser", "a", "b"]
    assert first.tolist() == [0, 3, 3, 5]
    matcher, worth = X.Matcher(LEXICON), np.full((len(LEXICON.entries), 3), 5.0)
    f = dict(zip(X.FEATURES, X.hit_features(
        ["you are an idiot and a loser", "the captain said idiot and left", 'he shouted "idiot, loser" over the radio', "nothing at all", "1diot l0ser"], matcher, worth).T))
    assert f["abuse"][0] > 0 and f["abuse"][1] == f["abuse"][2] == f["abuse"][3] == 0
    assert f["quoted"][1] > 0 and f["quoted"][2] > f["quoted"][1] and f["quoted"][0] == 0
    assert f["addressed"][0] > 0 and f["densest"][0] > 0 and f["exact"][4] == f["exact"][0]


def abusive(rng, clean, misspell):
    words = clean.split(" ")
    for _ in range(rng.randrange(2, 5)):
        w = rng.choice(("idiot", "worthless", "stupid", "disgusting", "moronic"))
        if misspell:
            i = rng.randrange(1, len(w) - 1)
            w = w[:i] + w[i + 1:] if rng.random() < 0.5 else w[:i] + "x" + w[i + 1:]
        words.insert(rng.randrange(len(words) + 1), w)
    return " ".join(words)


@pytest.fixture(scope="module")
def heard(spark, tmp_path_factory):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(900):
        text = " ".join("".join(rng.choice("aeioustrnlm") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(8, 60)))
        bad = i % 6 == 0
        rows.append((i, "tower", None, None, None, None, "en", abusive(rng, text, i % 4 == 0) if bad else text, 1.0))
        labels.append((i, int(bad)))
    path = str(tmp_path_factory.mktemp("heard") / "t")
    spark.createDataFrame(rows, schemas.TRANSCRIPTS).repartition(4).write.parquet(path)
    return readers.transcripts(spark, path), spark.createDataFrame(labels, "transcript_id BIGINT, toxic INT"), dict(labels)


def test_held_out_abuse_is_found(spark, heard):
    df, labels, truth = heard
    model = X.train(df, labels)
    assert {"idiot", "stupid", "worthless"} <= {t for t, *_ in model.lexicon.entries}
    out = X.score_transcripts(df, model).collect()
    assert {r.transcript_id for r in out} == set(truth) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.transcript_id).encode()) % 4 == 2) for r in out)
    test = [r for r in out if r.held_out]
    assert sum(r.predicted == truth[r.transcript_id] for r in test) > 0.97 * len(test)
    # labels of held-out transcripts are never looked at, other columns neither
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in truth.items()], labels.schema)
    assert [r.score for r in X.score_transcripts(df, X.train(df.withColumn("language", df.text), flipped)).orderBy("transcript_id").collect()] == [
        r.score for r in sorted(out, key=lambda r: r.transcript_id)]


def test_odd_rows(spark, heard):
    df, labels, _ = heard
    model = X.train(df, labels)
    odd = c.transcripts(spark, n=8, extra=((None, None, None, None, "", "", "", ""), (None, "idiot " * 5, None, None, "", "", "", "")))
    out = X.score_transcripts(odd.union(odd), model).collect()
    assert len(out) == 2 * odd.count() and not any(r.held_out for r in out if r.transcript_id is None)
    empty = {r.score for r in X.score_transcripts(spark.createDataFrame([(1, None), (2, ""), (3, " \n")], "transcript_id INT, text STRING"), model).collect()}
    assert len(empty) == 1 and max(empty) < 0.3
    assert X.score_transcripts(c.empty(spark), model).count() == 0
    none = spark.createDataFrame([(None, 1), (2, None)], "transcript_id BIGINT, toxic INT")
    assert {r.score for r in X.score_transcripts(df, X.train(df, none)).collect()} == {0.0}
    one = spark.createDataFrame([(i, 0) for i in range(20)], "transcript_id BIGINT, toxic INT")
    assert {r.predicted for r in X.score_transcripts(df, X.train(df, one)).collect()} == {0}


def test_parts_do_not_change_features(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choice((*TERMS, "wind", "you", '"', "said")) for _ in range(rng.randrange(40))) for _ in range(60)] + ["idiot " * 3000]
    worth = np.random.default_rng(1).random((len(LEXICON.entries), 3))
    whole = X.hit_features(texts, X.Matcher(LEXICON), worth)
    monkeypatch.setattr(X.pieces, "__defaults__", (50,))
    parts = [X.hit_features(t, X.Matcher(LEXICON), worth) for _, t in X._texts(pa.array(texts))]
    assert len(parts) > 50 and np.allclose(np.concatenate(parts), whole)
