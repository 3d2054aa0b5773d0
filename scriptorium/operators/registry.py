"""Tasks whose completion has to be verified: states by a fold over events, verdicts over outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.values import listed, output_hash
from scriptorium.operators.blocks import BLOCK, in_blocks, over_borders, so_far, with_carry

#: Characters of an output that a task keeps, and of the code's version that evidence names.
KEPT_OUTPUT, VERSION = 10_000, 12
STATES = ("pending", "in_progress", "claimed", "verified", "regressed")


def _led_to(before: Column, started: Column, completed: Column) -> Column:
    """The state after events without verify or fail, from the time of the first start and the last complete among them."""
    open_ = before.isin("pending", "regressed")
    return F.when(open_ & started.isNotNull(), F.when(completed > started, "claimed").otherwise("in_progress")).when((before == "in_progress") & completed.isNotNull(), "claimed").otherwise(before)


def _entries(rows: DataFrame) -> DataFrame:
    """(task_id, _block, entry): the state that each block of a task in several blocks begins with.

    A block's events are a function from the state before to the state after;
    functions of blocks that follow one another are composed in order. A task
    has as many as it has blocks.
    """
    at, reset = F.struct("ts", "event_id"), F.col("event").isin("verify", "fail")
    block = Window.partitionBy("task_id", BLOCK)
    marked = over_borders(rows, ["task_id"]).withColumn("at", at).withColumn("reset_at", F.max(F.when(reset, at)).over(block))
    tail = F.col("reset_at").isNull() | (F.col("at") > F.col("reset_at"))
    parts = marked.groupBy("task_id", BLOCK).agg(
        F.max_by("event", F.when(reset, F.col("at"))).alias("last"),
        F.min(F.when(tail & (F.col("event") == "start"), F.col("at"))).alias("started"),
        F.max(F.when(tail & (F.col("event") == "complete"), F.col("at"))).alias("completed"),
    )
    after_reset = F.when(F.col("last") == "verify", "verified").when(F.col("last") == "fail", "regressed")
    names = F.array(*map(F.lit, STATES))
    leads = F.array(*[_led_to(F.coalesce(after_reset, F.lit(s)), F.col("started"), F.col("completed")) for s in STATES])
    each = parts.select("task_id", F.struct(F.col(BLOCK), leads.alias("leads")).alias("x")).groupBy("task_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    none = F.array().cast(f"array<struct<{BLOCK}: int, entry: string>>")
    step = lambda a, x: F.struct(F.element_at(x["leads"], F.array_position(names, a["state"]).cast("int")).alias("state"), F.concat(a["out"], F.array(F.struct(x[BLOCK].alias(BLOCK), a["state"].alias("entry")))).alias("out"))
    folded = F.aggregate("x", F.struct(F.lit("pending").alias("state"), none.alias("out")), step, lambda a: a["out"])
    return each.select("task_id", F.inline(folded))


def _judged(events: DataFrame, blocks: int | None) -> DataFrame:
    """The allowed events with to_state and _block."""
    rows = in_blocks(events, ["task_id"], ["ts", "event_id"], blocks)
    known = with_carry(rows, _entries(rows), ["task_id"])
    order = Window.partitionBy("task_id", BLOCK).orderBy("ts", "event_id")
    reset = F.col("event").isin("verify", "fail")
    spans = known.withColumn("span", F.sum(reset.cast("int")).over(order))
    opened = F.max(F.when(reset, F.col("event"))).over(Window.partitionBy("task_id", BLOCK, "span"))
    before = F.when(opened == "verify", "verified").when(opened == "fail", "regressed").otherwise(F.coalesce("entry", F.lit("pending")))
    earlier = Window.partitionBy("task_id", BLOCK, "span").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda c: F.coalesce(F.max(c).over(earlier), F.lit(False))
    flagged = spans.withColumn("before", before).withColumn("started", F.col("before").isin("in_progress", "claimed") | (F.col("before").isin("pending", "regressed") & seen(F.col("event") == "start")))
    flagged = flagged.withColumn("closed", (F.col("before") == "claimed") | seen((F.col("event") == "complete") & F.col("started")))
    startable = (F.col("event") == "start") & F.col("before").isin("pending", "regressed") & ~F.col("started")
    completable = (F.col("event") == "complete") & F.col("started") & ~F.col("closed")
    to = F.when(F.col("event") == "verify", "verified").when(F.col("event") == "fail", "regressed").when(startable, "in_progress").when(completable, "claimed")
    taken = flagged.withColumn("to_state", to).filter("to_state is not null")
    was = F.coalesce(F.lag("to_state").over(order), "entry", F.lit("pending"))
    return taken.withColumn("from_state", was).drop("span", "before", "started", "closed", "entry")


def transitions(events: DataFrame, blocks: int | None = None) -> DataFrame:
    """The events(task_id, ts, event_id, event, ...) that are allowed, with from_state and to_state.

    `start` needs pending or regressed, `complete` needs in_progress, and
    `verify` and `fail` are taken in any state. Since a verify or fail, all that
    counts is the first start and the first complete after it. A task with many
    events lies in several blocks of time, which begin with the state that the
    blocks before lead to.
    """
    return _judged(events, blocks).drop(BLOCK)


def claimed_transitions(events: DataFrame, blocks: int | None = None) -> DataFrame:
    """transitions of events(…, agent_id) with claimed_by: the agent of the task's last allowed start, up to then."""
    started = F.when(F.col("event") == "start", F.struct("agent_id"))
    found = so_far(_judged(events, blocks), ["task_id"], ["ts", "event_id"], {"claimed_by": started})
    return found.withColumn("claimed_by", F.col("claimed_by.agent_id")).drop(BLOCK)


def task_states(events: DataFrame) -> DataFrame:
    """(task_id, state): the last allowed transition; pending without one."""
    last = transitions(events).groupBy("task_id").agg(F.max_by("to_state", F.struct("ts", "event_id")).alias("state"))
    return events.select("task_id").distinct().join(last, "task_id", "left").select("task_id", F.coalesce("state", F.lit("pending")).alias("state"))


def evidence(events: DataFrame, code_version: str = "") -> DataFrame:
    """The evidence that each allowed event leaves, to be appended, with its transition as `from->to` and the start of the code's version: verify and fail name no model."""
    anonymous = F.when(F.col("event").isin("verify", "fail"), F.lit("")).otherwise(F.col("model_id").cast("string"))
    return transitions(events).select("task_id", "ts", "event_id", "event", "to_state", F.concat("from_state", F.lit("->"), "to_state").alias("transition"), anonymous.alias("model_id"), F.lit(code_version[:VERSION]).alias("code_version"))


def task_evidence(events: DataFrame, state: str | None = None) -> DataFrame:
    """Each task's evidence by time with the task's state, or that of the tasks in one state only. Rows, not a list: a task's evidence has no bound."""
    states = task_states(events)
    states = states if state is None else states.filter(F.col("state") == state)
    return evidence(events).join(states, "task_id").orderBy("task_id", "ts", "event_id")


def model_performance(events: DataFrame) -> DataFrame:
    """(model_id, difficulty, attempts, successes, failures, success_rate) over events(…, agent_id, model_id, difficulty).

    A complete is an attempt of the model that it names; a verify or fail is a
    success or failure of the agent that claimed the task, whoever sends it.
    Nothing is counted for events without such a name.
    """
    of = lambda s: F.count_if(F.col("to_state") == s)
    taken = claimed_transitions(events).filter("event <> 'start'")
    credited = taken.withColumn("model_id", F.when(F.col("event") == "complete", F.col("model_id")).otherwise(F.col("claimed_by")))
    named = credited.filter(F.coalesce(F.col("model_id").cast("string"), F.lit("")) != "")
    counts = named.groupBy("model_id", "difficulty").agg(of("claimed").alias("attempts"), of("verified").alias("successes"), of("regressed").alias("failures"))
    return counts.withColumn("success_rate", F.try_divide("successes", F.col("successes") + F.col("failures")))


def verification(tasks: DataFrame) -> DataFrame:
    """tasks(…, command, timed_out, error, exit_code, expected_exit, stdout, contains, excludes) with reason, passed, output_hash and the first KEPT_OUTPUT characters of the output.

    The first failing rule is the reason: no command, timeout, error, exit
    code, a text that is missing, a text that is forbidden.
    """
    missing = F.get(F.filter("contains", lambda x: ~F.col("stdout").contains(x)), F.lit(0))
    forbidden = F.get(F.filter("excludes", lambda x: F.col("stdout").contains(x)), F.lit(0))
    reason = (
        F.when(F.coalesce(F.col("command"), F.lit("")) == "", "no verification command")
        .when(F.col("timed_out"), "timeout")
        .when(F.col("error").isNotNull(), "error")
        .when(F.col("exit_code") != F.col("expected_exit"), "exit code")
        .when(missing.isNotNull(), F.concat(F.lit("stdout missing: "), missing))
        .when(forbidden.isNotNull(), F.concat(F.lit("stdout contains forbidden: "), forbidden))
    )
    judged = tasks.withColumn("reason", F.coalesce(reason, F.lit("all checks passed"))).withColumn("passed", reason.isNull()).withColumn("output_hash", output_hash(F.col("stdout")))
    return judged.withColumn("verification_output", F.substring("stdout", 1, KEPT_OUTPUT))


def golden_drift(outputs: DataFrame, golden: DataFrame) -> DataFrame:
    """(task_id, output_key, drift) of golden(task_id, output_key, pattern, golden_value, tolerance): missing, value or text.

    The pattern's first match is compared by its first number, without sign;
    where a side has none, any other text is a drift.
    """
    both = golden.join(outputs, "task_id").withColumn("hit", F.nullif(F.regexp_substr("stdout", F.col("pattern")), F.lit("")))
    number = lambda c: F.regexp_extract(c, r"[\d.]+", 0).try_cast("double")
    a, b = number(F.col("hit")), number(F.col("golden_value"))
    drift = F.when(F.col("hit").isNull(), "missing").when((F.coalesce(F.col("golden_value"), F.lit("")) == "") | (F.col("hit") == F.col("golden_value")), None)
    drift = drift.when(a.isNull() | b.isNull(), "text").when(F.abs(a - b) > F.col("tolerance"), "value")
    return both.select("task_id", "output_key", drift.alias("drift")).filter("drift is not null")


def tasks_of(tasks: DataFrame, spec_id: str | None = None, state: str | None = None) -> DataFrame:
    """tasks(spec_id, task_id, state, ...) of one specification, in one state, or both, by specification and id."""
    if spec_id is not None:
        tasks = tasks.filter(F.col("spec_id") == spec_id)
    if state is not None:
        tasks = tasks.filter(F.col("state") == state)
    return tasks.orderBy("spec_id", "task_id")


def of_model(performance: DataFrame, model_id=None) -> DataFrame:
    """model_performance of one model, or of all."""
    return performance if model_id is None else performance.filter(F.col("model_id") == model_id)


def regress_check(states: DataFrame, tasks: DataFrame) -> DataFrame:
    """The verdict, anew, on each task that counts as verified; of one specification if tasks are tasks_of it."""
    return verification(tasks.join(states.filter("state = 'verified'").select("task_id"), "task_id", "left_semi"))
