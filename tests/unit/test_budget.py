"""Budgets filled over ranges, against a loop over each query's rows."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators.budget import fill_budget
from tests.conftest import rows_of

SCHEMA = "query_id string, id int, rank int, cost long"


@pytest.fixture(autouse=True)
def small_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def by_loop(rows, budget):
    spent, chosen = {}, []
    for query, id_, _, cost in sorted((r for r in rows if r[3] is not None), key=lambda r: (r[2], r[1], r[3])):
        cost = max(cost, 0)
        if spent.get(query, 0) + cost <= budget:
            spent[query] = spent.get(query, 0) + cost
            chosen.append((query, id_))
    return sorted(chosen, key=repr)


@pytest.mark.parametrize("budget", [0, 1, 37, 1000])
def test_one_query_may_hold_nearly_all_rows(spark, budget):
    rng = random.Random(budget)
    rows = [
        (None if i % 7 == 0 else "hot" if i % 3 else f"q{i % 5}", i, rng.randrange(900), rng.choice([None, 0, 1, 3, 40, 500, 999, 1200, rng.randrange(1000)]))
        for i in range(1500)
    ]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    expected = by_loop(rows, budget)
    assert rows_of(fill_budget(frame, budget)) == expected
    assert rows_of(fill_budget(frame, budget, folded=100)) == expected


def test_costs_that_shrink_slowly(spark):
    """Each row that fits leaves less than the next large one costs."""
    rows = [("q", i, i, 1 if i % 2 else 100 - i // 2) for i in range(200)]
    rows += [("r", i, 0, 2) for i in range(60)] + [("n", i, i, -5) for i in range(60)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(fill_budget(frame, 100, folded=10)) == by_loop(rows, 100)


def test_repeated_rows_and_empty_tables(spark):
    rows = [("q", 1, 1, 3)] * 40
    frame = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(fill_budget(frame, 10, folded=5)) == [("q", 1)] * 3
    assert fill_budget(frame.limit(0), 10).count() == 0
    wide = frame.withColumn("left", F.lit(1)).withColumn("_place", F.lit(1))
    assert rows_of(fill_budget(wide, 10, folded=5)) == [("q", 1)] * 3
