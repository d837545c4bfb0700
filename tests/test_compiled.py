"""Some queries as production runs them, with whole-stage code generation, which the rest of the suite leaves out to save time."""

import pytest

from streamlens import registry
from tests.test_queries import database, pytestmark  # noqa: F401
from tests.test_queries import test_query_matches_sql as matches

NAMES = ["burst_arcs", "window_statistics", "bm25_top", "snapped_windows", "moment_groups", "hashed_vectors", "live_telemetry", "priority_regions", "diverse_compilation"]


@pytest.fixture
def compiled(spark):
    before = spark.conf.get("spark.sql.codegen.wholeStage")
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    yield spark
    spark.conf.set("spark.sql.codegen.wholeStage", before)


@pytest.mark.parametrize("name", NAMES)
def test_compiled_query_matches_sql(compiled, database, name):  # noqa: F811
    assert name in registry.oracle_sql()
    matches(compiled, database, name)
