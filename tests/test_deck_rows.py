"""A whole deck's rows are made in one pass and stay narrow."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from streamlens.plans import moment_decks

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")


def test_deck_rows_are_made_once_and_fit_compiled_code(spark):
    limit = int(spark.conf.get("spark.sql.codegen.maxFields"))
    x = moment_decks.deck_rows(spark, str(DATA))
    assert len(x.columns) < limit / 2 and len(moment_decks._rows(spark, str(DATA)).columns) < limit / 2
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Join LeftOuter", plan)) == 1 and not re.search(r"Join Inner", plan)  # the faces' rescues; candidates do not meet themselves again
    assert x.count() == x.select("user_id", "id").distinct().count()


def test_events_without_a_recording_or_a_number_are_no_candidates(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/events.parquet").where("event_type = 'purchase'")
    odd = e.limit(2).withColumn("user_id", F.lit(None).cast("long")).unionByName(e.limit(3).withColumn("event_id", F.lit(None).cast("long")))
    e.unionByName(odd).write.parquet(f"{tmp_path}/events.parquet")
    ids = lambda folder: sorted((r["user_id"], r["id"], r["passes"]) for r in moment_decks.deck_rows(spark, str(folder)).select("user_id", "id", "passes").collect())
    assert ids(tmp_path) == ids(DATA)
