"""Tasks that require others: what stands behind some of them, and what can't be put in order at all.

Both walk the edges round by round. A round joins the tasks that the round
before has reached, or drops the edges that it has settled, and is stored; the
driver learns only whether anything is left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.tables import stored


def behind(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(task_id, steps): tasks that require one of seeds(task_id), by way of others or not, with the fewest edges(task_id, requires) to one; seeds themselves only if they lie behind a seed."""
    links = edges.select("task_id", "requires").filter("task_id is not null and requires is not null").distinct()
    rounds, front = [], seeds.select("task_id").filter("task_id is not null").distinct()
    while True:
        found = links.join(front.withColumnRenamed("task_id", "requires"), "requires", "left_semi").select("task_id").distinct()
        if rounds:
            found = found.join(reduce(DataFrame.union, rounds), "task_id", "left_anti")
        front = stored(found)
        if front.isEmpty():
            break
        rounds.append(front)
    steps = [r.withColumn("steps", F.lit(k)) for k, r in enumerate(rounds, 1)]
    return reduce(DataFrame.union, steps) if steps else front.withColumn("steps", F.lit(0))


def without_order(edges: DataFrame) -> DataFrame:
    """(task_id): the tasks on a cycle of edges(task_id, requires), and those behind one; they can never be started in order.

    Round by round the edges go whose required task has no edge left. Where
    nothing goes any more, only cycles and what is behind them are left.
    """
    left = stored(edges.select("task_id", "requires").filter("task_id is not null and requires is not null").distinct())
    count = left.count()
    while count:
        kept = stored(left.join(left.select(F.col("task_id").alias("requires")).distinct(), "requires", "left_semi").select("task_id", "requires"))
        now = kept.count()
        if now == count:
            break
        left, count = kept, now
    return left.select("task_id").distinct() if count else left.select("task_id").limit(0)


def problems(edges: DataFrame, states: DataFrame) -> DataFrame:
    """(task_id, problem): prerequisite_regressed for tasks behind a regressed one of states(task_id, state), cycle for those that can't be ordered."""
    held = behind(edges, states.filter("state = 'regressed'")).select("task_id", F.lit("prerequisite_regressed").alias("problem"))
    return held.union(without_order(edges).select("task_id", F.lit("cycle").alias("problem")))
