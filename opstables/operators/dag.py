"""Dependency graphs as tables: waves, checks, branches, mappings, map steps, roll-ups, lineage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from opstables.operators.conditions import Conditions, Term
from opstables.sources.scratch import stored


def _kept(df: DataFrame, label: str) -> DataFrame:
    """A stored table whose joins are by shuffles: broadcasts would pass it through the driver, again in every round."""
    return stored(df, label).hint("merge")


#: Rounds that one job takes, and jobs after which the counts that they stored are joined to one table.
ROUNDS_A_JOB, COMPACT_ROUNDS = 2, 8


def _heads(steps: DataFrame, deps: DataFrame, declared: DataFrame) -> DataFrame:
    """(step, head, dist): steps that wait for one step only are so many places behind the head of their chain; others are heads themselves."""
    one = deps.join(declared.where("n = 1"), "step").select(F.col("step").alias("id"), F.col("depends_on").alias("from_id"))
    rows = steps.join(one.withColumnRenamed("id", "step").hint("merge"), "step", "left").select(F.col("step").alias("id"), "from_id")
    return lineage(rows).select(F.col("node").alias("step"), F.col("root").alias("head"), F.col("depth").alias("dist"))


def waves(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(step, wave): 1 without dependencies, else one more than the latest of them; null on a cycle or behind an unknown step.

    Chains of steps with one dependency are first folded into their heads by doubling pointers, so they take rounds by the
    logarithm of their length.  Between heads, a round takes the frontier, the heads that became ready; it stores the
    new counts of the heads that wait for these, and nothing else.  Counts of many rounds are joined now and then.
    """
    deps = _kept(edges.select("step", "depends_on").distinct(), "deps")
    declared = deps.groupBy("step").agg(F.count("*").alias("n"))
    names = steps.select("step").distinct()
    heads = _kept(_heads(names, deps, declared), "heads")
    own = heads.where("head = step").select("step")
    known = heads.select(F.col("step").alias("depends_on"), F.col("head").alias("waits_for"), "dist")
    # of several dependencies in one chain, the last counts; what has no head is never there
    waits = deps.join(own, "step", "left_semi").join(known, "depends_on", "left").groupBy("step", "waits_for").agg(F.max("dist").alias("dist"))
    waits = _kept(waits.withColumn("n", F.count("*").over(Window.partitionBy("step"))), "waits")
    frontier = _kept(own.join(declared, "step", "left_anti").select("step", F.lit(1).cast("long").alias("wave")), "waves")
    done, counts = [frontier], []

    def met_by(ready: DataFrame, earlier: list[DataFrame]) -> DataFrame:
        """The heads that wait for the ready ones: what they have met so far, and where that puts them."""
        met = waits.join(ready.select(F.col("step").alias("waits_for"), "wave"), "waits_for")
        met = met.select("step", F.lit(1).cast("long").alias("k"), (F.col("wave") + F.col("dist") + 1).alias("wave"), "n", F.lit(True).alias("_new"))
        if earlier:
            met = met.unionByName(reduce(DataFrame.unionByName, earlier).withColumn("_new", F.lit(False)))
        found = met.groupBy("step").agg(
            F.count_if("_new") + F.coalesce(F.max(F.when(~F.col("_new"), F.col("k"))), F.lit(0)), F.max("wave"), F.max("n"), F.bool_or("_new")
        ).toDF("step", "k", "wave", "n", "_new")
        return found.where("_new").drop("_new")

    while True:
        # some rounds in one job; each counts on those before
        parts, ready, earlier = [], frontier, list(counts)
        for i in range(ROUNDS_A_JOB):
            met = met_by(ready, earlier)
            parts.append(met.withColumn("_round", F.lit(i)))
            ready = met.where("k = n").select("step", "wave")
            earlier.append(met.where("k < n"))
        new = _kept(reduce(DataFrame.unionByName, parts), "waves")
        frontier = new.where(F.col("k") == F.col("n")).where(F.col("_round") == ROUNDS_A_JOB - 1).select("step", "wave")
        done.append(new.where("k = n").select("step", "wave"))
        counts.append(new.where("k < n").drop("_round"))
        if frontier.isEmpty():
            break
        if len(counts) == COMPACT_ROUNDS:
            ended = reduce(DataFrame.unionByName, done)
            open_counts = reduce(DataFrame.unionByName, counts).join(ended.select("step").hint("merge"), "step", "left_anti")
            done, counts = [_kept(ended, "waves")], [_kept(open_counts.groupBy("step").agg(F.max("k").alias("k"), F.max("wave").alias("wave"), F.max("n").alias("n")), "waves")]
    found = reduce(DataFrame.unionByName, done).select(F.col("step").alias("head"), F.col("wave").alias("first"))
    placed = heads.join(found, "head").select("step", (F.col("first") + F.col("dist")).cast("int").alias("wave"))
    return names.join(placed.hint("merge"), "step", "left")


#: Rounds in which steps at the ends of the graph are cut off before components are sought.
TRIMS = 8


def cycle_steps(edges: DataFrame) -> DataFrame:
    """(step): the steps that lie on a cycle of (step, depends_on): members of strongly connected components, and steps that wait for themselves.

    Ends are trimmed; then each step takes the largest name that reaches it (its colour), and from the step
    of that name, back along the dependencies of its colour, are the members of its component.  They leave, and the rest
    is coloured anew.  A round is a step's distance; every pass finds a component for each colour.
    """
    left = _kept(edges.select("step", "depends_on").distinct(), "cycles")
    found = [left.where("step = depends_on").select("step")]
    for _ in range(TRIMS):
        inner = left.join(left.select(F.col("step").alias("depends_on")).distinct(), "depends_on", "left_semi")
        inner = _kept(inner.join(left.select(F.col("depends_on").alias("step")).distinct(), "step", "left_semi"), "cycles")
        n, left = left.count(), inner
        if inner.count() == n:
            break
    while not left.isEmpty():
        colour = _kept(left.select("step").unionByName(left.select(F.col("depends_on").alias("step"))).distinct().withColumn("colour", F.col("step")), "colours")
        changed = colour
        while not changed.isEmpty():
            offers = left.join(changed.withColumnsRenamed({"step": "depends_on", "colour": "offer"}), "depends_on").groupBy("step").agg(F.max("offer").alias("offer"))
            both = _kept(colour.join(offers, "step", "left").select("step", F.greatest("colour", "offer").alias("colour"), F.coalesce(F.col("offer") > F.col("colour"), F.lit(False)).alias("new")), "colours")
            colour, changed = both.select("step", "colour"), both.where("new").select("step", "colour")
        inside = left.join(colour, "step").join(colour.withColumnsRenamed({"step": "depends_on", "colour": "c"}), "depends_on").where("colour = c")
        inside = _kept(inside.select("step", "depends_on", "colour"), "cycles")
        members = frontier = _kept(colour.where("step = colour").select("step"), "members")
        while not frontier.isEmpty():
            back = inside.join(frontier, "step", "left_semi").select(F.col("depends_on").alias("step")).distinct()
            frontier = _kept(back.join(members.hint("merge"), "step", "left_anti"), "members")
            members = members.unionByName(frontier)
        members = _kept(members.join(colour, "step"), "members")
        sizes = members.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1")
        found.append(members.join(sizes, "colour", "left_semi").select("step"))
        rest = left.join(members.select("step"), "step", "left_anti")
        left = _kept(rest.join(members.select(F.col("step").alias("depends_on")), "depends_on", "left_anti"), "cycles")
    return reduce(DataFrame.unionByName, found).distinct()


def ready_steps(deps: DataFrame, progress: DataFrame) -> DataFrame:
    """Deps (step, depends array), progress (run_id, completed array, failed array): steps not yet run whose dependencies are complete."""
    completed = progress.select("run_id", F.explode("completed").alias("step"))
    failed = progress.select("run_id", F.explode("failed").alias("step"))
    return ready_after(deps.select("step"), deps.select("step", F.explode("depends").alias("depends_on")), progress.select("run_id"), completed, failed)


#: Steps without dependencies that are listed in the plan; if there are more, every run is paired with them by a join.
FIRST_STEPS = 1_000


def ready_after(steps: DataFrame, edges: DataFrame, runs: DataFrame, completed: DataFrame, failed: DataFrame) -> DataFrame:
    """I2 over rows: steps (step), edges (step, depends_on), runs (run_id), completed and failed (run_id, step).

    A run's completed steps meet the edges that wait for them; a step is ready when as many are complete as it declares.
    Each edge carries that number: rows of runs are many times those of steps, and most are of a few steps that all runs
    come to, so they are joined by a step once only, and then stay where their run and step put them.
    """
    deps = edges.select("step", "depends_on").distinct()
    listed = steps.select("step").distinct()
    numbered = deps.join(listed, "step", "left_semi").withColumn("n", F.count("*").over(Window.partitionBy("step")))
    met = completed.distinct().withColumnRenamed("step", "depends_on").join(numbered, "depends_on").groupBy("run_id", "step").agg(F.count("*").alias("k"), F.max("n").alias("n"))
    waited = met.where("k = n").select("run_id", "step")
    bare = listed.join(deps, "step", "left_anti")
    first = [F.lit(r["step"]) for r in bare.limit(FIRST_STEPS + 1).collect()]
    runs = runs.select("run_id").distinct()
    if len(first) <= FIRST_STEPS:
        free = runs.select("run_id", F.explode(F.array(*first).cast(ArrayType(steps.schema["step"].dataType))).alias("step"))
    else:
        free = runs.crossJoin(bare)  # each pair is a result, but for those that ran
    return waited.unionByName(free).join(completed.unionByName(failed), ["run_id", "step"], "left_anti")


def branch(df: DataFrame, condition: Callable[[Conditions], Term], name: str = "taken") -> DataFrame:
    """Whether a row takes a branch: where its condition is true, and where it can't be computed (see Conditions for what can't)."""
    term = condition(Conditions(df))
    return df.withColumn(name, F.coalesce(term.failed, F.lit(True)) | term.truth())


def map_inputs(df: DataFrame, mapping: dict[str, str], context: str = "context", results: str = "results") -> DataFrame:
    """I4: step inputs from the context, or, where that is empty or missing, from step results; nulls aren't written."""
    def pick(src: str) -> Column:
        own = F.try_element_at(context, F.lit(src))
        return F.coalesce(F.when(~F.coalesce(own, F.lit("")).isin("", "0", "false"), own), F.try_element_at(results, F.lit(src)))

    entries = F.filter(F.array(*(F.struct(F.lit(dst).alias("key"), pick(src).alias("value")) for dst, src in mapping.items())), lambda e: e["value"].isNotNull())
    return df.withColumn("step_input", F.map_from_entries(entries))


def map_outputs(df: DataFrame, mapping: dict[str, str], result: str = "result", context: str = "context") -> DataFrame:
    """I4: named results written to the context, over what was there."""
    new = F.map_filter(F.create_map(*(x for dst, src in mapping.items() for x in (F.lit(dst), F.try_element_at(result, F.lit(src))))), lambda _, v: v.isNotNull())
    old = F.map_filter(context, lambda k, _: ~F.map_contains_key(new, k))
    return df.withColumn(context, F.map_concat(old, new))


def map_step(df: DataFrame, run: str, items: str, fn: Callable[[Column], Column], failed: Callable[[Column], Column], policy: str = "abort_all", error: Callable[[Column], Column] | None = None) -> DataFrame:
    """Fn on each item (explode, apply, gather in order); items that aren't a list are a list of one.

    abort_all: any failed item fails the run.  continue: a failed item is null among the results, and stands in
    item_errors (map_index, map_error) with the error's text.
    """
    listed = F.col(items) if isinstance(df.schema[items].dataType, ArrayType) else F.array(items)
    rows = df.select(run, F.posexplode(listed).alias("idx", "item"))
    text = error(F.col("item")) if error else F.lit("failed")
    out = rows.select(run, "idx", F.coalesce(failed(F.col("item")), F.lit(False)).alias("bad"), fn(F.col("item")).alias("value"), text.alias("error"))
    each = F.sort_array(F.collect_list(F.struct("idx", F.when(~F.col("bad"), F.col("value")).alias("value"))))
    wrong = F.sort_array(F.collect_list(F.when(F.col("bad"), F.struct(F.col("idx").alias("map_index"), F.col("error").alias("map_error")))))
    found = out.groupBy(run).agg(each.alias("_each"), F.count_if("bad").alias("errors"), wrong.alias("item_errors"))
    results = F.transform("_each", lambda x: x["value"])
    status = F.when((F.col("errors") > 0) & F.lit(policy == "abort_all"), "failed").otherwise("completed")
    indexes = F.transform("item_errors", lambda x: x["map_index"])
    return found.select(run, status.alias("status"), F.when(status == "completed", results).alias("results"), "errors", indexes.alias("failed_items"), "item_errors")


def on_failure(df: DataFrame, value: str, error: str, action: str, fallback: Column | None = None) -> DataFrame:
    """Abort keeps null and flags the run; skip goes on with null; fallback goes on with a literal."""
    bad = F.col(error).isNotNull()
    if action == "fallback" and fallback is None:
        raise ValueError("a fallback is missing")
    filled = fallback if action == "fallback" else F.lit(None)
    return df.withColumns({value: F.when(bad, filled).otherwise(F.col(value)), "aborted": bad & F.lit(action == "abort")})


def run_status(outcomes: DataFrame) -> DataFrame:
    """Outcomes (run_id, wave, aborted): a run fails at its first wave with an aborting failure; later waves don't run."""
    failed = F.min(F.when(F.col("aborted"), F.col("wave")))
    return outcomes.groupBy("run_id").agg(F.when(failed.isNotNull(), "failed").otherwise("completed").alias("status"), failed.alias("failed_wave"), F.count("*").alias("steps"))


def collect_steps(results: DataFrame, run: str = "run_id", order: str = "seq", value: str = "result") -> DataFrame:
    """I8: a run's results in order."""
    return results.groupBy(run).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("results"))


def check_dag(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(step, problem): repeated steps, dependencies on unknown steps, steps on a cycle, and steps blocked behind one or behind an unknown
    step; if steps has on_failure and fallback, fallbacks that are missing.
    """
    names = steps.select("step").distinct()
    twice = steps.groupBy("step").count().where("count > 1").select("step", F.lit("duplicate step").alias("problem"))
    unknown = edges.join(names.withColumnRenamed("step", "depends_on").hint("merge"), "depends_on", "left_anti").select("step", F.lit("unknown dependency").alias("problem")).distinct()
    stuck = _kept(waves(steps, edges).where("wave IS NULL").select("step"), "stuck")
    found = twice.unionByName(unknown)
    if not stuck.isEmpty():
        among = edges.select("step", "depends_on").join(stuck, "step", "left_semi").join(stuck.withColumnRenamed("step", "depends_on"), "depends_on", "left_semi")
        cycle = cycle_steps(among)
        blocked = stuck.join(cycle, "step", "left_anti").join(unknown.select("step").hint("merge"), "step", "left_anti")
        found = found.unionByName(cycle.withColumn("problem", F.lit("cycle"))).unionByName(blocked.withColumn("problem", F.lit("blocked")))
    if not {"on_failure", "fallback"} <= set(steps.columns):
        return found
    bare = steps.where("on_failure = 'fallback' AND fallback IS NULL").select("step", F.lit("missing fallback").alias("problem")).distinct()
    return found.unionByName(bare)


def lineage(edges: DataFrame, node: str = "id", parent: str = "from_id") -> DataFrame:
    """(node, root, depth) of chains of replays, by pointer doubling.

    Rounds grow with the logarithm of the longest chain, and end at that of the number of nodes: what has
    no root by then is on a cycle (of one row, too) or behind one, and has a null root and depth.  A parent that
    is not among the nodes is a root.
    """
    start = edges.select(F.col(node).alias("node"), F.coalesce(parent, node).alias("up"), F.when(F.col(parent).isNull(), 0).otherwise(1).cast("bigint").alias("depth"), F.col(parent).isNull().alias("done"))
    now = _kept(start, "lineage")
    for _ in range(max(1, now.count()).bit_length() + 1):
        left = now.where("NOT done")
        if left.isEmpty():
            break
        above = now.select(F.col("node").alias("_n"), F.col("up").alias("_up"), F.col("depth").alias("_d"), F.col("done").alias("_done"))
        moved = left.join(above, F.col("up") == F.col("_n"), "left").select("node", F.coalesce("_up", "up").alias("up"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"), F.coalesce("_done", F.lit(True)).alias("done"))
        now = _kept(now.where("done").unionByName(moved), "lineage")
    return now.select("node", F.when(F.col("done"), F.col("up")).alias("root"), F.when(F.col("done"), F.col("depth")).alias("depth"))


@dataclass
class Pipeline:
    """Steps as functions of named DataFrames; Spark runs them lazily and together."""

    steps: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = field(default_factory=dict)

    def step(self, name: str, *needs: str) -> Callable:
        def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            if name in self.steps:
                raise ValueError(f"step {name} is there twice")
            self.steps[name] = (needs, f)
            return f

        return add

    def run(self, context: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Applies the steps in the order of their needs; those on a cycle or with unknown needs are left out."""
        done = dict(context)
        left = dict(self.steps)
        while ready := [n for n, (needs, _) in left.items() if all(x in done for x in needs)]:
            for n in ready:
                needs, f = left.pop(n)
                done[n] = f(*(done[x] for x in needs))
        return done
