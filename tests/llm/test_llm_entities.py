"""Every transcript operator runs with its default arguments on what the library's reader returns."""

import corpus as c
import pytest
from pyspark.sql import functions as F

from aetherlog import schemas
from aetherlog.llm import (
    alignment, decontamination, jaccard, line_dedup, pieces, quality_classifier, quality_rules, repeats, resampling, sharding, toxicity,
)
from aetherlog.sources import readers


@pytest.fixture(scope="module")
def heard(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("entities") / "t")
    rows = [(r[0], r[3], None, "noaa-seattle", None, None, r[2], r[1], 1.0) for r in c.rows(4, 14)]
    spark.createDataFrame(rows, schemas.TRANSCRIPTS).repartition(2).write.parquet(path)
    return readers.transcripts(spark, path)


def test_operators_take_transcripts(spark, heard):
    n = heard.count()
    references = spark.createDataFrame([(1, "an evaluation text that occurs nowhere here")], "reference_id BIGINT, text STRING")
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(n)], "transcript_id BIGINT, quality INT, toxic BOOLEAN").withColumn(
        "toxic", F.col("toxic").cast("int"))
    runs = {
        "quality rules": quality_rules.quality_rules(heard), "line dedup": line_dedup.dedup_lines(heard),
        "similar": jaccard.similar_transcripts(heard), "shards": sharding.minimax_shards(heard), "pieces": pieces.encode(heard),
        "repeats": repeats.remove_repeats(heard), "decontaminate": decontamination.decontaminate(heard, references),
        "quality": quality_classifier.score_transcripts(heard, quality_classifier.train(heard, labels)),
        "toxicity": toxicity.score_transcripts(heard, toxicity.train(heard, labels)),
        "resample": resampling.resample(heard, references), "alignment": alignment.token_links(heard),
    }
    for name, out in runs.items():
        assert "transcript_id" in out.columns and out.count() == n, name
