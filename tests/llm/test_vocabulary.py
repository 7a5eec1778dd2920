"""LM scores of a table with more words than 16 bits number."""

import glob
import os

import duckdb

from skein.llm import oracles
from skein.llm.lm_score import score_lm
from tests.conftest import rows_of

TABLES = "/root/testdata/sf0.01"


def test_lm_scores_know_every_word(spark):
    """69,556 words: more than 16 bits number."""
    connection = duckdb.connect()
    files = f"{TABLES}/documents.parquet"
    files += "/*.parquet" if os.path.isdir(files) and glob.glob(f"{files}/*.parquet") else ""
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{files}'")
    want = dict((r[0], r[1:]) for r in connection.sql(oracles.OP5).fetchall())
    got = {r[0]: r[1:] for r in score_lm(spark.read.parquet(f"{TABLES}/documents.parquet")).collect()}
    assert got.keys() == want.keys()
    for key, (n, total, mean) in want.items():
        assert got[key][0] == n and abs(got[key][1] - total) < 1e-5
        assert (got[key][2] is None) == (mean is None) and abs((got[key][2] or 0) - (mean or 0)) < 2e-6


def test_lm_scores_of_wide_ids_are_the_same(spark):
    docs = spark.createDataFrame([(i, f"a b w{i} x{i % 3} y a b {'z ' * i}") for i in range(40)], "doc_id long, text string")
    wide = rows_of(score_lm(docs, hot=2, partition=50, narrow=0))
    assert wide == rows_of(score_lm(docs, hot=2, partition=50)) and len(wide) == 40


def test_words_that_all_occur_equally_often_are_scored(spark):
    """70,000 words, each once: every word scores 1 / 70,000, and a following one backs off."""
    docs = spark.range(700).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(0, 99), i -> concat('w', id, 'x', i))) AS text")
    want = round(100 * -11.156250521 + 99 * -0.916290732, 3)
    assert {(r.n_words, round(r.log_score, 3)) for r in score_lm(docs).collect()} == {(100, want)}
