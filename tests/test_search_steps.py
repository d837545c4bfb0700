"""Search steps do their work once per text and once per vector."""

import math
import re
import time

from pyspark.sql import functions as F

from streamlens.functions.strings import tokens
from streamlens.operators import search

TEXTS = ["The licence's the THE, other", "érst erste Erst_x 'erst the", None, "", "under the lice\U00010400the the\U00010400", "a-the.licensed/under the", "ÉTHE the1 1the İthe ... the"]


def test_words_that_begin_alike_are_those_of_all_words(spark):
    begins = ["the", "erst", "lice", "lice'"]
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").select(tokens(F.col("text")).alias("all"), tokens(F.col("text"), begins).alias("few")).collect()
    assert sum(len(r["few"]) for r in rows) > 12
    for r in rows:
        assert r["few"] == [w for w in r["all"] if w.startswith(tuple(begins))]


def test_counted_cuts_each_text_into_words_once(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    found = {"n": lambda words, few: F.size(F.filter(few, lambda w: F.startswith(w, F.lit("lice")))), "together": lambda words, few: search.matches(few, [["lice"]]) & search.matches(words, [], [["under", "the"]])}
    x = search.counted(docs, "id", {"text": F.col("text")}, ["the", "erst"], "text", begins=["lice"], found=found)
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"regexp_extract_all\(", plan)) == 2  # all words, and the few that the query asks about
    words = dict(docs.select("id", tokens(F.col("text"))).collect())
    for r in x.collect():
        w = words[r["id"]]
        n = sum(v.startswith("lice") for v in w)
        assert (r["length0"], r["tf0_0"], r["tf0_1"], r["n"], r["together"]) == (len(w), w.count("the"), w.count("erst"), n, n > 0 and " under the " in f" {' '.join(w)} ")


def test_a_unit_vector_grows_with_the_length_of_its_vector(spark):
    size = 10000
    v = spark.range(4).select("id", F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: ((i * (F.col("id") + 3)) % 17 - 5).cast("float")).alias("v")).coalesce(1)
    begun = time.monotonic()
    got = dict(v.select("id", search.unit(F.col("v"))).collect())
    assert time.monotonic() - begun < 10  # with a length summed for each component these are 400 million steps
    for k, unit in got.items():
        mine = [float((i * (k + 3)) % 17 - 5) for i in range(1, size + 1)]
        length = math.sqrt(sum(x * x for x in mine))
        assert unit == [x / length for x in mine]


def test_zero_and_empty_vectors_are_near_nothing(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, None), (4, [None, 1.0]), (5, [])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in search.cosine_top(v, "vec_id", "embedding", [6.0, 8.0], 9).collect()] == [(2, 1.0)]
    assert search.cosine_top(v, "vec_id", "embedding", [0.0, 0.0], 9).collect() == [] and search.cosine_top(v, "vec_id", "embedding", [], 9).collect() == []
