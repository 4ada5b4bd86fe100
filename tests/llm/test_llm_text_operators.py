"""Text operators against plain versions, on whole small tables with odd rows."""

import hashlib
import random
import zlib

import corpus as c
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aetherlog.llm import decontamination, jaccard, line_dedup, pieces, quality_classifier, quality_rules, repeats, sharding


@pytest.fixture(scope="module")
def frame(spark):
    return c.transcripts(spark).cache()


@pytest.fixture(scope="module")
def pairs():
    return [(r[0], r[1]) for r in c.rows()]


def by_id(df):
    return {r["transcript_id"]: r for r in df.collect()}


# --- quality rules ---------------------------------------------------------------------------

def test_quality_counts(frame, pairs):
    got = by_id(quality_rules.quality_rules(frame))
    for i, t in pairs:
        n, chars, symbols, dup, repeat = want = c.counts(t)
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_symbols"], got[i]["n_dup_lines"], got[i]["n_repeat_words"]) == want, t
        assert got[i]["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert not (got[i]["kept"] and got[i]["base_failed"])


def test_quality_thresholds_follow_the_stratum(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(f"{'####' if i % 2 and k % 5 == 0 else ''}{rng.choice('abcdefgh')}{rng.randrange(999)}" for k in range(80)),
             "en", "marked" if i % 2 else "plain") for i in range(600)]
    rows += [(1000, rows[1][1], "en", "plain"), (1001, rows[1][1], "en", "marked"), (1002, rows[0][1], "xx", None)]
    got = by_id(quality_rules.quality_rules(spark.createDataFrame(rows, "transcript_id BIGINT, text STRING, language STRING, stream_id STRING")))
    assert all(got[i]["kept"] for i in range(600))                   # usual for its own stratum
    assert not got[1000]["kept"] and got[1001]["kept"]              # the same text among plain ones is an outlier
    assert got[1002]["kept"]                                         # a rare language is judged by all


def test_quality_empty_and_repeated(spark, frame):
    assert quality_rules.quality_rules(c.empty(spark)).count() == 0
    assert quality_rules.quality_rules(frame.union(frame)).count() == 2 * frame.count()


# --- line dedup -------------------------------------------------------------------------------

def test_line_dedup_equals_plain_version(frame, pairs):
    got = by_id(line_dedup.dedup_lines(frame, keep=("stream_id",)))
    want = c.line_runs(pairs)
    assert {i: got[i]["text"] for i, _ in pairs} == want
    assert sum(r["n_removed"] > 0 for r in got.values()) > 5
    assert all((r["n_removed"] > 0) == (r["n_runs"] > 0) for r in got.values())


def test_line_dedup_edges(spark):
    long = " ".join(f"t{i}" for i in range(60))
    half = [" ".join(f"{x}{i}" for i in range(30)) for x in "ab"]
    rows = [(1, f"intro\n{long}\nrest"), (2, f"other\n  {long}\t\nmore"), (3, "\n".join(half)), (4, f"x\n{half[0]}\n\n{half[1]}\ny"),
            (5, half[0]), (6, None), (7, ""), (8, f"{long}\n{long}\n{long}"), (8, f"{long}\n{long}\n{long}"), (None, long)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "transcript_id BIGINT, text STRING")).collect()
    out = {r["transcript_id"]: (r["text"], r["n_lines"], r["n_removed"], r["n_runs"]) for r in got}
    assert len(got) == len(rows)
    # a null key comes first, so its copy of the line is the one that stays
    assert out[None][0] == long and out[1] == ("intro\nrest", 3, 1, 1) and out[2] == ("other\nmore", 3, 1, 1)
    assert out[3][0] == "\n".join(half) and out[4] == ("x\ny", 5, 3, 1) and out[5][2] == 0
    assert out[6] == (None, 0, 0, 0) and out[7] == ("", 0, 0, 0) and out[8] == ("", 3, 3, 1)
    assert line_dedup.dedup_lines(c.empty(spark)).count() == 0


def test_line_dedup_is_native(frame):
    plan = line_dedup.windows(line_dedup.spoken_lines(frame), 50)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- similarity join ------------------------------------------------------------------------------

def test_similar_transcripts_equal_all_pairs(frame, pairs):
    got = by_id(jaccard.similar_transcripts(frame))
    want = c.similar(pairs)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert sum(v[1] != i for i, v in want.items()) > 8


def test_similar_chains_and_large_families(spark):
    """Copies that drift apart link only along the chain; shards of two sets must lose no link."""
    rng = random.Random(5)
    words = [f"v{i}" for i in range(120)]
    rows, step = [], list(words)
    for i in range(40):
        rows.append((i, " ".join(step)))
        step[rng.randrange(len(step))] = f"new{i}"
        step[rng.randrange(len(step))] = f"more{i}"
    base = [f"z{i}" for i in range(90)]
    for i in range(60):
        w = list(base)
        w[rng.randrange(90)] = f"edit{i}"
        if i % 2:
            w[rng.randrange(90)] = f"other{i}"
        rows.append((100 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "transcript_id BIGINT, text STRING")
    want = c.similar(rows)
    for shard in (200, 100_000):
        got = by_id(jaccard.similar_transcripts(df, shard_shingles=shard))
        assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want


def test_similar_edges(spark):
    rows = [(5, "a b c"), (3, "A B C"), (9, "a b c d e"), (4, None), (2, ""), (1, "  \n"), (None, "a b c"), (None, None), (5, "a b c")]
    got = jaccard.similar_transcripts(spark.createDataFrame(rows, "transcript_id BIGINT, text STRING")).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == sorted([
        ("5", 1, "3"), ("5", 1, "3"), ("3", 1, "3"), ("9", 1, "9"), ("4", 0, "4"), ("2", 0, "2"), ("1", 0, "1"), ("None", 1, "3"), ("None", 0, "None")])
    assert jaccard.similar_transcripts(c.empty(spark)).count() == 0


def test_similar_blocks_are_in_proportion_to_their_shingles():
    """What a block of texts sends must not grow with the number of buckets, which follows the size of the whole table."""
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(14)) for _ in range(800)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(800), pa.int64()), pa.array(texts)], names=["k", "t"])

    def sent(buckets):
        out = pa.Table.from_batches(jaccard._block_rows(batch, buckets, 5))
        return out.select([n for n, t in zip(out.column_names, out.schema.types) if pa.types.is_binary(t) and n not in ("sizes", "local")]).nbytes

    assert sent(256) < 3 * sent(16)


def test_similar_common_passage_brings_nobody_together(spark, monkeypatch):
    """Sets that share a passage, and can't be linked for the rest of their shingles, are not sent to a search, let alone to every shard."""
    rng = random.Random(7)
    passage, parts = [f"p{i}" for i in range(60)], [[f"q{j}x{i}" for i in range(16)] for j in range(40)]
    rows = []
    for i in range(120):  # a passage, and two pieces of many; their shingles all occur elsewhere
        a, b = rng.sample(range(40), 2)
        rows.append((i, " ".join(passage + parts[a] + parts[b] + [f"own{i}"])))
    rows += [(200, "a b c d e f g h i j k l m n o p q r s t"), (201, "a b c d e f g h i j k l m n o p q r s t u")]
    sent, links = [], jaccard._links
    monkeypatch.setattr(jaccard, "_links", lambda assigned, *a: (sent.append(assigned.count()), links(assigned, *a))[1])
    df = spark.createDataFrame(rows, "transcript_id BIGINT, text STRING")
    got = by_id(jaccard.similar_transcripts(df, shard_shingles=600))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == c.similar(rows)
    assert sent[1] < 1200  # every set with every shard: above 1,700


# --- decontamination -------------------------------------------------------------------------------

REFERENCES = ["the quick brown fox jumps over the lazy dog while nine other animals watch from the fence in silence",
              "Wind südwest fünfzehn Knoten, Böen bis dreißig, Sicht gut, später mäßig; Druck fällt langsam bis zum Abend.",
              "short reference of words", "tiny", None, ""]


def edited(rng, text, k):
    s = list(text)
    for _ in range(k):
        i = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[i] = rng.choice("qzé~")
        elif kind == 1:
            del s[i]
        else:
            s.insert(i, rng.choice("qzé~"))
    return "".join(s)


def test_leaked_references(spark):
    rng = random.Random(2)
    refs = spark.createDataFrame(list(enumerate(REFERENCES)), "reference_id INT, text STRING")
    rows, want = [], set()
    for i in range(60):
        r = i % 3
        budget = len(REFERENCES[r]) * 10 // 100
        host = c.sentences(rng, rng.randrange(0, 4))
        rows.append((i, f"{host} {edited(rng, REFERENCES[r], rng.randrange(budget + 1))} {host}"))
        want.add((i, r))
    rows += [(100, c.sentences(rng, 50)), (101, None), (102, ""), (103, edited(rng, REFERENCES[0], 45)), (104, REFERENCES[1].upper()),
             (105, "tiny"), (106, REFERENCES[0][:60]), (107, REFERENCES[0].replace(" ", "\n")), (107, REFERENCES[0].replace(" ", "\n"))]
    want |= {(104, 1), (107, 0)}
    df = spark.createDataFrame(rows, "transcript_id BIGINT, text STRING")
    for block in (1 << 20, 60):
        got = decontamination.leaked_references(df, refs, block_chars=block).collect()
        assert {(r["transcript_id"], r["reference_id"]) for r in got} == want
        assert sum(r["transcript_id"] == 107 for r in got) == 2
    text = dict(rows)
    for r in got:
        k = len(REFERENCES[r["reference_id"]]) * 10 // 100
        assert r["edits"] <= k and abs(r["stop"] - r["start"] - len(REFERENCES[r["reference_id"]])) <= k
        if r["edits"] == 0 and r["transcript_id"] < 100:
            assert text[r["transcript_id"]][r["start"]:r["stop"]].lower() == REFERENCES[r["reference_id"]].lower()
    clean = decontamination.decontaminate(df, refs)
    assert {r["transcript_id"] for r in clean.collect()} == {100, 101, 102, 103, 105, 106}
    assert clean.columns == df.columns


def test_leaked_references_empty(spark):
    refs = spark.createDataFrame([], "reference_id INT, text STRING")
    df = c.transcripts(spark, n=12)
    assert decontamination.leaked_references(df, refs).count() == 0
    assert decontamination.decontaminate(df, refs).count() == df.count()
    some = spark.createDataFrame([(1, REFERENCES[0])], "reference_id INT, text STRING")
    assert decontamination.leaked_references(c.empty(spark), some).count() == 0


# --- SentencePiece ---------------------------------------------------------------------------------

def test_ids_equal_the_library_and_come_back(frame, pairs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    encoded = pieces.encode(frame)
    got = by_id(encoded)
    for i, t in pairs:
        assert got[i]["ids"] == library.encode(t or ""), t
        assert got[i]["exact"] and got[i]["n_ids"] == len(got[i]["ids"])
    again = by_id(pieces.decode(encoded))
    assert all(again[i]["text"] == (t or "") for i, t in pairs)


def test_ids_of_odd_texts(spark):
    odd = ["", " ", "   a", "a" + " " * 40 + "b", "▁ literal ▁▁", "\x00\x7f", "🙂 é́ ﬁ", "x" * 3000 + " y", " nbsp", "tab\tline\n"]
    df = spark.createDataFrame(list(enumerate([*odd, None])), "transcript_id BIGINT, text STRING")
    got = by_id(pieces.encode(df))
    assert all(r["exact"] for r in got.values()) and got[0]["ids"] == [] and got[len(odd)]["ids"] == []
    again = by_id(pieces.decode(pieces.encode(df)))
    assert [again[i]["text"] for i in range(len(odd))] == odd
    assert pieces.encode(c.empty(spark)).count() == 0


def test_workers_keep_vocabularies_apart(monkeypatch):
    """The same pieces with other ranks give other ids, whichever vocabulary a process has used before."""
    texts = pa.array(["the captain reported strong winds over the northern straits"] * 3 + [" ".join(t.split()[:200]) for t in c.texts(2, 9) if t])
    first = pieces.load_vocabulary()

    def turned(rows, n, plain=pieces._merge_tables):
        return plain([(t, i, -s) for t, i, s in rows], n)
    monkeypatch.setattr(pieces, "_merge_tables", turned)
    second = pieces.load_vocabulary()
    alone = []
    for voc in (first, second):
        pieces._seen.clear()
        alone.append(pieces.encode_array(texts, voc)[0].tolist())
    assert alone[0] != alone[1]
    assert [pieces.encode_array(texts, v)[0].tolist() for v in (second, first, second)] == [alone[1], alone[0], alone[1]]


def test_unigram_search_has_the_largest_sum():
    import numpy as np

    voc = pieces.load_vocabulary(kind="unigram")
    score = {}
    for i, k, s in zip(voc.ids, range(len(voc.ids)), voc.scores):
        score[bytes(voc.data[voc.offsets[i]:voc.offsets[i + 1]]).decode()] = s
    rng = random.Random(4)
    for _ in range(60):
        word = " " + "".join(rng.choice("theraonid") for _ in range(rng.randrange(1, 9)))
        best = [0.0] + [-np.inf] * len(word)
        for e in range(1, len(word) + 1):
            best[e] = max(best[b] + score[word[b:e]] for b in range(e) if word[b:e] in score)
        back, piece = pieces.viterbi(np.array([[ord(x) for x in word]], np.uint32), voc)
        at, total = len(word), 0.0
        while at:
            total += voc.scores[np.flatnonzero(voc.ids == piece[0, at])[0]]
            at -= back[0, at]
        assert total == pytest.approx(best[-1])


# --- repeated byte strings -----------------------------------------------------------------------

def test_remove_repeats_equals_plain_version(frame, pairs):
    got = by_id(repeats.remove_repeats(frame))
    want = c.without_repeats(pairs)
    for i, t in pairs:
        assert (bytes(got[i]["kept"]), len(got[i]["spans"])) == want[i], i
        assert got[i]["n_bytes"] == len((t or "").encode()) and got[i]["n_removed"] == got[i]["n_bytes"] - len(got[i]["kept"])
    assert sum(r["n_removed"] > 0 for r in got.values()) > 15


def test_remove_repeats_in_many_groups(spark, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP_BYTES", 2000)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 3000)
    rng = random.Random(9)
    part = ["".join(rng.choice("ab ") for _ in range(rng.randrange(30, 140))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(part) + rng.choice(["", "x", "yy"]) for _ in range(rng.randrange(0, 8)))) for i in range(70)]
    rows += [(200, "ab" * 400), (201, "ab" * 300), (202, "ba" * 30)]
    got = by_id(repeats.remove_repeats(spark.createDataFrame(rows, "transcript_id BIGINT, text STRING")))
    want = c.without_repeats(rows)
    assert {i: (bytes(r["kept"]), len(r["spans"])) for i, r in got.items()} == want


def test_hot_anchor_is_dealt_out():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    passage = "".join(rng.choice(letters) for _ in range(120))
    rows = [(i, "".join(rng.choice(letters) for _ in range(90)) + passage + "".join(rng.choice(letters) for _ in range(90))) for i in range(400)]
    rows[350] = (350, rows[3][1])
    rows[351] = (351, "other " + rows[351][1][60:])
    groups, buckets, n = 40, 8, 50
    parts = {g: pa.table({"g": pa.array([g] * 10, pa.int64()), "key": pa.array([r[0] for r in rows[g::groups]], pa.int64()),
                          "body": pa.array([r[1].encode() for r in rows[g::groups]], pa.binary())}) for g in range(groups)}

    def by(tables, column):
        t = pa.concat_tables([t for t in tables if t.num_rows])
        return {v: t.filter(pa.array([x == v for x in t.column(column).to_pylist()])) for v in set(t.column(column).to_pylist())}
    shared = by([repeats._repeated(t) for t in by([repeats._mark(buckets, n)(t) for t in parts.values()], "bucket").values()], "g")
    around = by([repeats._contexts(buckets, n)(parts[g], shared[g]) for g in shared], "bucket")
    most = 0
    for t in around.values():
        values = np.concatenate([np.frombuffer(v, np.uint64) for v in t.column("values").to_pylist()])
        most = max(most, np.unique(values, return_counts=True)[1].max())
    assert most <= groups  # one task no longer takes a stretch of every transcript with the passage
    cuts = by([repeats._factors(n)(t) for t in around.values()], "g")
    got = {}
    for g, t in parts.items():
        empty = pa.table({"cut": pa.array([], pa.binary())})
        got |= {r["key"]: (r["kept"], len(r["spans"])) for r in repeats._cut(t, cuts.get(g, empty)).to_pylist()}
    assert got == c.without_repeats(rows)


def test_remove_repeats_edges(spark):
    body = "a sentence that is long enough to be looked at by the operator, certainly"
    rows = [(None, body), (None, body), (4, body), (4, body), (7, body), (8, body[:49]), (9, None), (10, "")]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "transcript_id BIGINT, text STRING")).collect()
    assert sorted((str(r[0]), bytes(r["kept"]).decode()) for r in got) == sorted(
        [("None", body), ("None", body), ("4", body), ("4", body), ("7", ""), ("8", body[:49]), ("9", ""), ("10", "")])
    assert repeats.remove_repeats(c.empty(spark)).count() == 0


def test_previous_factors():
    import numpy as np

    rng = np.random.default_rng(1)
    s = rng.integers(0, 2, (120, 9)).astype(np.uint8)
    doc = rng.integers(0, 15, 120)
    got = repeats.previous_factors(s, doc)
    for i in range(120):
        want = max([next((k for k in range(9) if s[i, k] != s[j, k]), 9) for j in range(120) if doc[j] < doc[i]], default=0)
        assert got[i] == want


# --- sharding ---------------------------------------------------------------------------------------

def least_capacity(sizes, k):
    def fits(cap):
        n, room = 1, cap
        for s in sizes:
            if s > cap:
                return False
            if s > room:
                n, room = n + 1, cap
            room -= s
        return n <= k
    lo, hi = max(sizes, default=0), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("shards", [1, 3, 8, 200])
def test_minimax_shards(spark, frame, shards):
    extra = [(9000 + i, "hot text" * 40, "en", "s", "x", "y", "z", "q") for i in range(60)] + [(None, "n", "en", "s", "x", "y", "z", "q")]
    df = c.transcripts(spark, extra=tuple(extra))
    got = sharding.minimax_shards(df, shards=shards, rows_per_cell=7).collect()
    source = {r["transcript_id"]: r["text"] for r in df.collect()}
    assert len(got) == df.count()
    order = {r["text"] or "": r["h"] for r in df.select("text", sharding._order_key(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    group: dict[int, int] = {}
    load: dict[int, int] = {}
    slots: dict[int, list[int]] = {}
    place: dict[str, int] = {}
    for r in got:
        t = source[r["transcript_id"]] or ""
        assert r["size"] == len(t.encode()) + 1 and r["text_crc32"] == zlib.crc32(t.encode()) and r["law"] == "bytes" and r["grown_shard"] is None
        group[order[t]] = group.get(order[t], 0) + r["size"]
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert place.setdefault(t, r["shard"]) == r["shard"]
    assert max(load.values()) == least_capacity([group[k] for k in sorted(group)], shards) and max(load) < shards
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    ranked = sorted(place.items(), key=lambda x: order[x[0]])
    assert [s for _, s in ranked] == sorted(s for _, s in ranked)


def test_minimax_refines_where_a_cut_falls(spark):
    """Keys that differ in their lowest bits only: every range must be split to the end."""
    rows = [(k, 10 + k % 7) for k in range(-40, 60)]
    groups = spark.createDataFrame(rows, "order_key BIGINT, size BIGINT")
    capacity, cuts = sharding.minimax_cuts(groups, 8)
    assert capacity == least_capacity([s for _, s in sorted(rows)], 8)
    assert len(cuts) == 7 and cuts == sorted(cuts)
    assert sharding.minimax_shards(c.empty(spark)).count() == 0


# --- quality classifier --------------------------------------------------------------------------

def test_classifier_learns_and_ignores_the_held_out(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 != 0
        w = [rng.choice("abcdefghij") * rng.randrange(1, 4) + rng.choice("aeiou") for _ in range(rng.randrange(20, 350))]
        at = rng.randrange(len(w))
        rows.append((i, " ".join(w if good else w[:at] + ["BUY$$$!!"] * 40 + w[at:])))
        held = zlib.crc32(str(i).encode()) % 3 == 1
        labels.append((i, int(good != held)))  # wrong labels in the held-out part must do no harm
    labels += [(None, 1), (3, None), (100000, 1)]
    df = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "x" * 300_000)], "transcript_id BIGINT, text STRING")
    model = quality_classifier.train(df, spark.createDataFrame(labels, "transcript_id BIGINT, quality INT"))
    got = by_id(quality_classifier.score_transcripts(df, model))
    right = [got[i]["predicted"] == int(i % 3 != 0) for i, _ in rows if got[i]["held_out"]]
    assert sum(right) >= 0.97 * len(right) and len(right) > 80
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert got[900]["score"] == got[901]["score"]


def test_classifier_without_labels(spark):
    df = c.transcripts(spark, n=12)
    none = spark.createDataFrame([], "transcript_id BIGINT, quality INT")
    got = quality_classifier.score_transcripts(df, quality_classifier.train(df, none)).collect()
    assert {r["score"] for r in got} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(30)], "transcript_id BIGINT, quality INT")
    assert {r["score"] for r in quality_classifier.score_transcripts(df, quality_classifier.train(df, one)).collect()} == {1.0}
    assert quality_classifier.score_transcripts(c.empty(spark), quality_classifier.Model()).count() == 0


def test_gradient():
    import numpy as np

    rng = np.random.default_rng(0)
    x, begin, y = rng.random((12, quality_classifier.WIDTH)), np.array([0, 3, 4, 9, 12]), np.array([1.0, 0, 1, 0])
    model = quality_classifier.fit(x, begin, y, steps=200)
    assert ((model.score(x, begin) >= 0.5) == (y > 0)).all()


def test_hash_of_kept_bytes(frame, pairs):
    r = repeats.remove_repeats(frame).select("transcript_id", F.sha2("kept", 256).alias("h")).collect()
    want = c.without_repeats(pairs)
    assert all(x["h"] == hashlib.sha256(want[x["transcript_id"]][0]).hexdigest() for x in r)
