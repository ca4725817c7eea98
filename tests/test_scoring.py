"""Scoring rules against hand-checked values of the duplicate scoring table."""

import pytest
from pyspark.sql import functions as F

from boardlake.functions import scoring

# (level, strain, dbl, vul, tricks, expected declarer score)
GRID = [
    (1, "N", "", False, 7, 90),
    (4, "S", "", False, 10, 420),
    (4, "S", "", True, 10, 620),
    (6, "N", "", True, 12, 1440),
    (3, "N", "", False, 9, 400),
    (3, "N", "", True, 10, 630),
    (2, "C", "", False, 8, 90),
    (5, "D", "", True, 11, 600),
    (1, "C", "X", False, 7, 140),
    (1, "N", "X", False, 7, 180),
    (2, "H", "X", True, 8, 670),
    (1, "S", "XX", False, 8, 720),
    (7, "C", "", False, 13, 1440),
    (7, "N", "", True, 13, 2220),
    (4, "H", "", False, 9, -50),
    (4, "H", "", True, 7, -300),
    (4, "H", "X", False, 9, -100),
    (4, "H", "X", False, 8, -300),
    (4, "H", "X", False, 7, -500),
    (4, "H", "X", False, 6, -800),
    (4, "H", "X", True, 9, -200),
    (4, "H", "X", True, 7, -800),
    (4, "H", "XX", True, 7, -1600),
    (7, "C", "XX", True, 0, -7600),
    (3, "N", "X", False, 10, 650),
    (3, "N", "XX", True, 10, 1400),
]


def test_score_grid(spark):
    rows = spark.createDataFrame(GRID, "level int, strain string, dbl string, vul boolean, tricks int, expected int")
    got = rows.select(
        "expected",
        scoring.score("level", "strain", "dbl", "vul", F.col("tricks") - 6 - F.col("level")).alias("got"),
    ).collect()
    assert [r.got for r in got] == [r.expected for r in got]


def test_score_table_size_and_sets_doubled(spark):
    t = scoring.score_table(spark)
    assert t.count() == 2940
    one = t.filter("level = 3 and strain = 'N' and tricks = 8 and vul = false and dbl = 'X'").first()
    assert one.score == -100


def test_null_inputs_give_null(spark):
    df = spark.createDataFrame([(None, None, None, None, None)], "level int, strain string, dbl string, vul boolean, r int")
    assert df.select(scoring.score("level", "strain", "dbl", "vul", "r").alias("s")).first().s is None


@pytest.mark.parametrize("dbl,expected", [("", 1), ("X", 2), ("XX", 4)])
def test_double_multiplier(spark, dbl, expected):
    df = spark.createDataFrame([(dbl,)], "d string")
    assert df.select(scoring.double_multiplier(F.col("d")).alias("m")).first().m == expected
