"""Budgets filled in rank order by rows of any cost, for queries of any number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.running import in_ranges, running
from skein.session import cut_lineage

#: Rows of a query that one task folds in one go; a query with more is filled in phases.
FOLDED = 10_000


def fill_budget(rows: DataFrame, budget: int, folded: int = FOLDED) -> DataFrame:
    """(query_id, id) chosen in order of (rank, id, cost); a row that does not fit is skipped, later
    ones may fit.

    Rows that cost more than the whole budget, or whose cost is null, are never chosen and go first.
    Costs are whole; a negative one counts as zero. Null query ids are one query. Queries with up to
    ``folded`` rows are folded in one row each, larger ones by ``fill_in_phases``: the choice is the same.
    """
    cost = F.greatest(F.col("cost").cast("long"), F.lit(0).cast("long"))
    fit = rows.where(F.col("cost") <= budget).select("query_id", "id", "rank", cost.alias("cost"))
    sizes = fit.groupBy("query_id").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > folded)
    large = cut_lineage(sizes.select(F.col("query_id").alias("_q")))
    if large.isEmpty():
        return fold(fit, budget)
    same = F.col("query_id").eqNullSafe(F.col("_q"))
    small = fit.join(large, same, "left_anti")
    return fold(small, budget).unionByName(fill_in_phases(fit.join(large, same, "left_semi"), budget))


def fold(rows: DataFrame, budget: int) -> DataFrame:
    """The choice for queries whose rows fit in one row's array."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "id", "cost")))
    start = F.struct(F.lit(0).cast("long").alias("spent"), F.array().cast(f"array<{dict(rows.dtypes)['id']}>").alias("ids"))

    def take(state: Column, row: Column) -> Column:
        fits = state["spent"] + row["cost"] <= budget
        return F.struct(
            F.when(fits, state["spent"] + row["cost"]).otherwise(state["spent"]).alias("spent"),
            F.when(fits, F.concat(state["ids"], F.array(row["id"]))).otherwise(state["ids"]).alias("ids"),
        )

    chosen = rows.groupBy("query_id").agg(F.aggregate(ordered, start, take)["ids"].alias("ids"))
    return chosen.select("query_id", F.explode("ids").alias("id"))


def halved(left: Column) -> Column:
    """The greatest power of two up to ``left``; 1 if nothing is left."""
    digits = F.length(F.bin(left)) - 1
    return F.when(left < 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), digits))


def fill_in_phases(rows: DataFrame, budget: int) -> DataFrame:
    """The choice for queries of any size, none of which is gathered.

    With ``left`` in [h, 2h), h a power of two, a row below h always fits and one from h on fits at
    most once, as it takes ``left`` below h. So a phase, which lasts as long as ``left`` stays in
    [h, 2h), takes every small row, and ends with the first row whose running total of small rows
    takes ``left`` below h, or with the first larger row that fits beside that total. Each phase at
    least halves the budget: there are no more of them than the budget has binary digits. A phase is
    one running total over ranges and one row a query; chosen rows are known by the phases at the end.
    """
    order = ["rank", "id", "cost"]
    placed = running(in_ranges(rows, ["query_id"], order), ["query_id"], order, "_place", F.lit(1).cast("long"))
    placed = cut_lineage(placed)
    spans = cut_lineage(placed.groupBy("query_id", "_range").agg(F.max("_place").alias("_last")))
    interval = "array<struct<after:long,last:long,half:long>>"
    states = spans.select("query_id").distinct().select(
        "query_id", F.lit(budget).cast("long").alias("left"), F.lit(0).cast("long").alias("after"),
        F.lit(False).alias("done"), F.array().cast(interval).alias("phases"),
    )
    states = cut_lineage(states)
    while not states.where(~F.col("done")).isEmpty():
        states = cut_lineage(next_phase(placed, spans, states))
    told = with_state(placed, spans, states.select("query_id", "phases"))
    place, cost = F.col("_place"), F.col("cost")
    taken = F.exists("phases", lambda p: (place > p["after"]) & (place <= p["last"]) & ((cost < p["half"]) | (place == p["last"])))
    return told.where(taken).select("query_id", "id")


def with_state(placed: DataFrame, spans: DataFrame, states: DataFrame) -> DataFrame:
    """Placed rows with their query's state. It is looked up by range, so that a query of many rows
    is not dealt to one task."""
    named = states.withColumnRenamed("query_id", "_q")
    by_range = spans.join(named, F.col("query_id").eqNullSafe(F.col("_q"))).drop("_q", "_last")
    by_range = by_range.withColumnRenamed("query_id", "_q").withColumnRenamed("_range", "_r")
    same = (F.col("_range") == F.col("_r")) & F.col("query_id").eqNullSafe(F.col("_q"))
    return placed.join(by_range, same).drop("_q", "_r")


def next_phase(placed: DataFrame, spans: DataFrame, states: DataFrame) -> DataFrame:
    """The states after one more phase of each query that is not done."""
    going = states.where(~F.col("done")).withColumn("half", halved(F.col("left")))
    cost, left, half = F.col("cost"), F.col("left"), F.col("half")
    rows = with_state(placed, spans, going.select("query_id", "left", "after", "half"))
    rows = rows.where((F.col("_place") > F.col("after")) & (cost <= left))
    summed = running(rows, ["query_id"], ["_place"], "_small", F.when(cost < half, cost).otherwise(F.lit(0).cast("long")))
    left_here = left - F.col("_small")
    ends = (left > 0) & F.when(cost < half, left_here < half).otherwise(cost <= left_here)
    left_after = left_here - F.when(cost < half, F.lit(0).cast("long")).otherwise(cost)
    first = summed.where(ends).groupBy("query_id").agg(F.min_by(F.struct(left_after.alias("rest"), F.col("_place").alias("at")), "_place").alias("end"))
    told = going.join(first.withColumnRenamed("query_id", "_q"), F.col("query_id").eqNullSafe(F.col("_q")), "left").drop("_q")
    last = F.coalesce("end.at", F.lit(2**63 - 1))
    phase = F.struct(F.col("after"), last.alias("last"), half)
    moved = told.select(
        "query_id", F.coalesce("end.rest", left).alias("left"), last.alias("after"), F.col("end").isNull().alias("done"),
        F.concat("phases", F.array(phase)).alias("phases"),
    )
    return moved.unionByName(states.where("done"))
