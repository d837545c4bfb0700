"""What a query's text asks for."""

import pytest
from pyspark.sql import functions as F

from streamlens.operators import planning, search

DAY = "2024-03-12"


def planned(spark, text, given=None):
    r = planning.plan_filters(spark.createDataFrame([(text,)], "text string"), "text", F.lit(DAY).cast("date"), given).first()
    return r.rest, r.kind, r.decision, str(r.date_from) if r.date_from else None, str(r.date_to) if r.date_to else None


def test_only_one_month_counts_and_the_other_stays_in_the_text(spark):
    assert planned(spark, "best moments last month or this month") == ("moments or this month", None, None, "2024-02-01", "2024-02-29")
    assert planned(spark, "this month") == ("", None, None, "2024-03-01", "2024-03-31")


def test_given_dates_and_filters_win(spark):
    given = {"date_from": "2024-02-10", "kind": "moment"}
    assert planned(spark, "clips last month", given) == ("", "moment", None, "2024-02-10", "2024-02-29")
    assert planned(spark, "a fight", given) == ("a fight", "moment", None, "2024-02-10", None)


def test_quoted_phrases_and_families():
    assert search.asked('the "Big Boss Fight" sniped it', planning.STOP, [["snipe", "sniped", "no scope"]]) == ([["snipe", "sniped"]] if "it" in planning.STOP else [["snipe", "sniped"], ["it"]], [["big", "boss", "fight"]])
    assert search.asked('"a b"') == ([], [["a", "b"]])
    with pytest.raises(ValueError):
        search.asked("the", planning.STOP)
