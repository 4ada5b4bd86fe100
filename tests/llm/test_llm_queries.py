"""The registered queries: against their SQL on the smallest tables, and against plain versions on a small folder."""

import random
import zlib

import corpus as c
import corpus_pipeline
import numpy as np
import pytest
from compare import compare, duck
from pyspark.sql import functions as F

from aetherlog.llm import alignment, pieces, quality_rules
from aetherlog.llm.queries import ORACLE, QUERIES
from test_llm_alignment import got, plain

FOLDER = "/root/testdata/sf0.001"
ITEM = "an item of the evaluation set that must not be found in any document that goes on to the training of models"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    ok, _, message = compare(spark, QUERIES[name], ORACLE[name], FOLDER, duck(FOLDER))
    assert ok, message


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(12)
    rows = [(i, t, (lang or "xx"), (src or "s"), len(t or "")) for i, t, lang, src, *_ in c.rows(5, 70)]
    start = len(rows)
    for i in range(40):  # longer clean texts, some with an item, some copied with small changes
        words = [f"v{rng.randrange(5000):x}{rng.choice('aeiou')}" for _ in range(90 + i)]
        rows.append((start + i, " ".join(words) + (f" {ITEM} " if i % 8 == 0 else "") + " tail", "en", "s", 0))
        if i % 5 == 1:
            words[3] = "changed"
            rows.append((start + 100 + i, " ".join(words) + " tail", "en", "s", 0))
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(7, ITEM), (8, "another item that occurs nowhere in these few documents")], "item_id BIGINT, text STRING").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i, *_ in rows], "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{path}/labels.parquet")
    return path, {r[0]: r[1] for r in rows}


def kept(texts: dict) -> set:
    """Quality verdicts with the exact quartiles of all texts that pass the base rules."""
    measured = {i: c.counts(t) for i, t in texts.items()}
    passed = {i: m for i, m in measured.items() if m[0] >= 50 and 100 * m[4] <= 50 * m[0]}
    share = {"symbol_share": lambda m: m[2] / max(m[1], 1), "dup_line_share": lambda m: 30 * m[3] / m[0],
             "repeat_share": lambda m: m[4] / m[0], "word_length": lambda m: m[1] / m[0]}
    out = set(passed)
    for name, f in share.items():
        values = [f(m) for m in passed.values()]
        q25, q75 = np.quantile(values, [0.25, 0.75], method="inverted_cdf")
        fence = q75 + max(3 * (q75 - q25), quality_rules.SLACK[name])
        out -= {i for i, m in passed.items() if f(m) > fence}
    return out


def test_queries_without_sql(spark, folder):
    path, texts = folder
    assert set(QUERIES) - set(ORACLE) == {"op2_decontamination", "op7_quality_classifier", "op8_quality_rules", "op9_sentencepiece",
                                          "op12_toxicity", "op13_token_alignment"}
    found = {(r.doc_id, r.item_id) for r in QUERIES["op2_decontamination"](spark, path).collect()}
    assert found == {(i, 7) for i, t in texts.items() if ITEM in (t or "")}
    rules = {r.doc_id: r for r in QUERIES["op8_quality_rules"](spark, path).collect()}
    assert {i for i, r in rules.items() if r.kept} == kept(texts)
    assert {i: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for i, r in rules.items()} == {i: c.counts(t) for i, t in texts.items()}
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    ids = {r.doc_id: r for r in QUERIES["op9_sentencepiece"](spark, path).collect()}
    assert all(r.exact and r.ids == library.encode(texts[i] or "") for i, r in ids.items()) and set(ids) == set(texts)
    scored = QUERIES["op7_quality_classifier"](spark, path).collect()
    assert {r.doc_id for r in scored} == set(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in scored)

    abuse = QUERIES["op12_toxicity"](spark, path).collect()
    assert {r.doc_id for r in abuse} == set(texts) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in abuse)
    with open(alignment.BYTE_BPE, "rb") as f, open(alignment.PIECE_BPE, "rb") as g:
        files = f.read(), g.read()
    assert got(QUERIES["op13_token_alignment"](spark, path), "doc_id") == plain(list(texts.items()), files)


def test_pipeline_equals_plain_stages(spark, folder):
    path, texts = folder
    left = {i: texts[i] for i in kept(texts)}
    cut = c.line_runs(list(left.items()))
    left = {i: t for i, t in cut.items() if t == left[i] or c.WORD.search(t)}
    near = c.similar(list(left.items()))
    left = {i: t for i, t in left.items() if near[i][1] == i}
    copies = len(near) - len(left)
    left = {i: t for i, t in left.items() if ITEM not in t}
    out = corpus_pipeline.run(spark, path)
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == set(left) and copies > 3
    assert all(r.exact and r.n_chars == len(left[i]) for i, r in got.items())
    decoded = {r.doc_id: r.text for r in pieces.decode(out, keep=("doc_id",)).collect()}
    assert decoded == left


def test_pipeline_stages(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    odd = docs.limit(0).unionByName(spark.createDataFrame(
        [(None, None, None, None, None), (None, "word " * 60, None, None, 5), (1, None, "en", None, 0), (1, None, "en", None, 0)], docs.schema))
    for name, stage in corpus_pipeline.STAGES:
        for table in (odd, docs.limit(0)):
            out = stage(spark, table, path)
            assert out.count() <= table.count(), name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
    # a repeated row shares the fate of its twin; clean documents pass every filter
    clean = docs.filter("doc_id >= 84").withColumn("text", F.concat(F.col("text"), F.lit(" x "), F.col("doc_id").cast("string")))
    assert corpus_pipeline.STAGES[1][1](spark, clean, path).count() == clean.count()
