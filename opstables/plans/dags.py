"""Queries of opstables.operators.dag."""

from pyspark.sql import functions as F

from opstables.operators import dag
from opstables.plans.registry import query


def _steps(edges):
    return edges.select("step").unionByName(edges.select(F.col("depends_on").alias("step"))).distinct()


_WAVES = """WITH RECURSIVE nodes AS (SELECT step FROM dag_steps UNION SELECT depends_on FROM dag_steps),
  r(step, wave) AS (SELECT step, 1 FROM nodes WHERE step = 0 UNION SELECT d.step, r.wave + 1 FROM r JOIN dag_steps d ON d.depends_on = r.step)"""


@query("i1_waves", "dag_steps", f"{_WAVES} SELECT step, max(wave) AS wave FROM r GROUP BY step")
def _(edges):
    return dag.waves(_steps(edges), edges)


@query(
    "i2_ready_steps", "dag_steps nation",
    """WITH p AS (SELECT n_nationkey AS run_id, n_nationkey + 3 AS top FROM nation), s AS (SELECT DISTINCT step FROM dag_steps)
       SELECT run_id, s.step FROM p, s WHERE s.step > top AND s.step <> 40 AND NOT EXISTS (SELECT 1 FROM dag_steps d WHERE d.step = s.step AND d.depends_on > top)""",
)
def _(edges, nation):
    deps = edges.groupBy("step").agg(F.collect_set("depends_on").alias("depends"))
    progress = nation.selectExpr("CAST(n_nationkey AS BIGINT) AS run_id", "sequence(0L, CAST(n_nationkey + 3 AS BIGINT)) AS completed", "array(40L) AS failed")
    return dag.ready_steps(deps, progress)


@query(
    "i2_ready_steps_runs", "lineitem dag_steps",
    """WITH lines AS (SELECT l_orderkey AS run_id, l_partkey AS part, CAST(l_linenumber AS BIGINT) AS line, l_returnflag = 'R' AS failed FROM lineitem),
       ran AS (SELECT run_id, part AS step, failed FROM lines UNION SELECT run_id, line, false FROM lines UNION SELECT run_id, 0, false FROM lines WHERE run_id % 4 <> 0),
       done AS (SELECT DISTINCT run_id, step FROM ran WHERE NOT failed),
       near AS (SELECT DISTINCT run_id, d.step FROM done JOIN dag_steps d ON d.depends_on = done.step),
       lacks AS (SELECT n.run_id, n.step FROM near n JOIN dag_steps d USING (step) ANTI JOIN done ON done.run_id = n.run_id AND done.step = d.depends_on),
       found AS (SELECT * FROM near EXCEPT SELECT * FROM lacks UNION SELECT run_id, 0 FROM lines)
       SELECT run_id, step FROM found EXCEPT SELECT run_id, step FROM ran""",
)
def _(lines, edges):
    lines = lines.selectExpr("CAST(l_orderkey AS BIGINT) AS run_id", "CAST(l_partkey AS BIGINT) AS part", "CAST(l_linenumber AS BIGINT) AS line", "l_returnflag = 'R' AS failed")
    completed = lines.where("NOT failed").selectExpr("run_id", "part AS step").unionByName(lines.selectExpr("run_id", "line AS step")).unionByName(lines.where("run_id % 4 <> 0").selectExpr("run_id", "0L AS step"))
    return dag.ready_after(_steps(edges), edges, lines.select("run_id"), completed, lines.where("failed").selectExpr("run_id", "part AS step"))


# numbers are texts in a row's map: some aren't numbers, some aren't there, and every seventh row has no map
_I3 = """r AS (SELECT task_id, timeout_seconds, callback_url, task_id % 7 <> 0 AS has, CASE task_id % 4 WHEN 0 THEN 'abc' WHEN 1 THEN NULL ELSE CAST(task_id % 10 AS VARCHAR) END AS n, status FROM tasks)"""


@query(
    "i3_branch", "tasks",
    f"""WITH {_I3} SELECT task_id, timeout_seconds IS NULL OR (timeout_seconds > 600 AND coalesce(contains(callback_url, 'http://cb/1'), false)) AS taken,
          NOT has OR n IS NULL OR try_cast(n AS INT) IS NULL OR CAST(try_cast(n AS INT) AS INT) > 3 AS taken_by_number,
          NOT has OR status IN ('queued', 'running') OR n IS NULL AS taken_by_state, false AS taken_by_missing FROM r""",
)
def _(tasks):
    entries = F.map_from_arrays(F.array(F.lit("n"), F.lit("status")), F.array(F.expr("CASE task_id % 4 WHEN 0 THEN 'abc' WHEN 1 THEN NULL ELSE CAST(task_id % 10 AS STRING) END"), F.col("status")))
    rows = tasks.withColumn("ctx", F.when(F.col("task_id") % 7 != 0, entries)).withColumn("number", F.expr("try_cast(ctx['n'] AS INT)"))
    rows = dag.branch(rows, lambda c: c.every(c.compare(c.name("timeout_seconds"), ">", 600), c.member("http://cb/1", c.name("callback_url"))))
    rows = dag.branch(rows, lambda c: c.compare(c.name("number"), ">", 3), "taken_by_number")
    rows = dag.branch(rows, lambda c: c.some(c.member(c.name("ctx.status"), ["queued", "running"]), c.compare(c.name("ctx.n"), "==", None)), "taken_by_state")
    rows = dag.branch(rows, lambda c: c.every(c.compare(c.name("nowhere"), "==", "x"), c.negated(c.name("nowhere"))), "taken_by_missing")
    return rows.select("task_id", "taken", "taken_by_number", "taken_by_state", "taken_by_missing")


@query(
    "i4_input_mapping", "tasks",
    """SELECT task_id, CASE WHEN task_id % 3 = 0 THEN concat('r', CAST(task_id AS VARCHAR)) ELSE tenant_id END AS who, CASE WHEN task_id % 5 <> 0 THEN status END AS state FROM tasks""",
)
def _(tasks):
    rows = tasks.select(
        "task_id",
        F.map_from_arrays(F.array(F.lit("tenant")), F.array(F.when(F.col("task_id") % 3 == 0, "").otherwise(F.col("tenant_id")))).alias("context"),
        F.map_from_arrays(F.array(F.lit("tenant"), F.lit("status")), F.array(F.concat(F.lit("r"), F.col("task_id").cast("string")), F.when(F.col("task_id") % 5 != 0, F.col("status")))).alias("results"),
    )
    mapped = dag.map_inputs(rows, {"who": "tenant", "state": "status"})
    return mapped.select("task_id", F.try_element_at("step_input", F.lit("who")).alias("who"), F.try_element_at("step_input", F.lit("state")).alias("state"))


@query(
    "i4_output_mapping", "tasks",
    "SELECT task_id, CASE WHEN task_id % 4 = 0 THEN 'old' ELSE status END AS outcome, 'kept' AS other FROM tasks",
)
def _(tasks):
    context = F.create_map(F.lit("outcome"), F.lit("old"), F.lit("other"), F.lit("kept")).alias("context")
    result = F.map_from_arrays(F.array(F.lit("s")), F.array(F.when(F.col("task_id") % 4 != 0, F.col("status")))).alias("result")
    mapped = dag.map_outputs(tasks.select("task_id", context, result), {"outcome": "s"})
    return mapped.selectExpr("task_id", "context['outcome'] AS outcome", "context['other'] AS other")


def _items(orders):
    return orders.select(F.col("o_orderkey").alias("run_id"), F.expr("sequence(CAST(o_orderkey AS BIGINT), CAST(o_orderkey + o_custkey % 4 AS BIGINT))").alias("items"))


@query(
    "i5_map_step_abort", "orders",
    """WITH i AS (SELECT o_orderkey AS run_id, unnest(range(o_orderkey, o_orderkey + o_custkey % 4 + 1)) AS x FROM orders)
       SELECT run_id, CASE WHEN count(*) FILTER (x % 7 = 0) > 0 THEN 'failed' ELSE 'completed' END AS status,
              CASE WHEN count(*) FILTER (x % 7 = 0) = 0 THEN string_agg(CAST(x * x AS VARCHAR), ',' ORDER BY x) END AS results, count(*) FILTER (x % 7 = 0) AS errors FROM i GROUP BY run_id""",
)
def _(orders):
    found = dag.map_step(_items(orders), "run_id", "items", lambda x: x * x, lambda x: x % 7 == 0)
    return found.select("run_id", "status", F.array_join("results", ",").alias("results"), "errors")


@query(
    "i5_map_step_continue", "orders",
    """WITH i AS (SELECT o_orderkey AS run_id, unnest(range(o_orderkey, o_orderkey + o_custkey % 4 + 1)) AS x FROM orders)
       SELECT run_id, 'completed' AS status, string_agg(CASE WHEN x % 7 = 0 THEN '-' ELSE CAST(x * x AS VARCHAR) END, ',' ORDER BY x) AS results,
              coalesce(string_agg(CAST(x - run_id AS VARCHAR), ',' ORDER BY x) FILTER (x % 7 = 0), '') AS failed_items FROM i GROUP BY run_id""",
)
def _(orders):
    found = dag.map_step(_items(orders), "run_id", "items", lambda x: x * x, lambda x: x % 7 == 0, "continue")
    return found.select("run_id", "status", F.array_join("results", ",", "-").alias("results"), F.array_join("failed_items", ",").alias("failed_items"))


@query(
    "i5_map_step_errors", "orders",
    """SELECT o_orderkey AS run_id, 'completed' AS status, CASE WHEN o_orderkey % 7 = 0 THEN '-' ELSE CAST(o_orderkey * 2 AS VARCHAR) END AS results,
              CASE WHEN o_orderkey % 7 = 0 THEN '0:seventh' ELSE '' END AS item_errors FROM orders""",
)
def _(orders):
    rows = orders.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderkey").alias("item"))  # no list: a list of one
    found = dag.map_step(rows, "run_id", "item", lambda x: x * 2, lambda x: x % 7 == 0, "continue", lambda x: F.lit("seventh"))
    shown = F.transform("item_errors", lambda e: F.concat_ws(":", e["map_index"].cast("string"), e["map_error"]))
    return found.select("run_id", "status", F.array_join("results", ",", "-").alias("results"), F.array_join(shown, ",").alias("item_errors"))


@query("i6_on_failure", "task_runs", "SELECT run_key, CASE WHEN status = 'failed' THEN -1 ELSE attempt END AS result, false AS aborted FROM task_runs")
def _(runs):
    rows = runs.select("run_key", F.col("attempt").alias("result"), F.when(F.col("status") == "failed", "boom").alias("error"))
    return dag.on_failure(rows, "result", "error", "fallback", F.lit(-1)).drop("error")


@query(
    "i7_run_status", "task_runs",
    """SELECT task_id AS run_id, CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'failed' ELSE 'completed' END AS status,
              min(attempt) FILTER (status = 'failed') AS failed_wave, count(*) AS steps FROM task_runs GROUP BY 1""",
)
def _(runs):
    return dag.run_status(runs.select(F.col("task_id").alias("run_id"), F.col("attempt").alias("wave"), (F.col("status") == "failed").alias("aborted")))


@query("i8_collect_steps", "task_events", "SELECT task_id AS run_id, string_agg(event, ',' ORDER BY id) AS results FROM task_events GROUP BY 1")
def _(events):
    rows = events.select(F.col("task_id").alias("run_id"), F.col("id").alias("seq"), F.col("event").alias("result"))
    return dag.collect_steps(rows).select("run_id", F.array_join("results", ",").alias("results"))


# step 7 isn't there, and 20 and 40 wait for each other: members of the cycle are those that 20 leads to and that lead to 20
_CHECKED = """WITH RECURSIVE e AS (SELECT step, depends_on FROM dag_steps UNION SELECT 20, 40), bad AS (SELECT DISTINCT step FROM e WHERE depends_on = 7),
       later(step) AS (SELECT 20 UNION SELECT e.step FROM later JOIN e ON e.depends_on = later.step), prior(step) AS (SELECT 20 UNION SELECT e.depends_on FROM prior JOIN e ON e.step = prior.step),
       ring AS (SELECT step FROM later SEMI JOIN prior USING (step)), r(step) AS (SELECT step FROM bad UNION SELECT step FROM ring UNION SELECT e.step FROM r JOIN e ON e.depends_on = r.step)
       SELECT step, 'duplicate step' AS problem FROM (SELECT DISTINCT step FROM dag_steps WHERE step % 100 = 50)
       UNION ALL SELECT step, 'unknown dependency' FROM bad UNION ALL SELECT step, 'cycle' FROM ring UNION ALL SELECT step, 'blocked' FROM r ANTI JOIN bad USING (step) ANTI JOIN ring USING (step)"""


def _checked(edges):
    names = _steps(edges).where("step <> 7")
    ring = edges.limit(1).selectExpr("20L AS step", "40L AS depends_on")
    return dag.check_dag(names.unionByName(names.where("step % 100 = 50")), edges.unionByName(ring))


@query("i9_check_dag", "dag_steps", _CHECKED)
def _(edges):
    return _checked(edges)


@query("i9_check_dag_all", "dag_steps", _CHECKED)
def _(edges):
    return _checked(edges)


@query("i9_missing_fallback", "dag_steps", "SELECT DISTINCT step, 'missing fallback' AS problem FROM dag_steps WHERE step % 3 = 0 AND step % 2 = 0")
def _(edges):
    steps = edges.select("step").distinct().selectExpr("step", "CASE WHEN step % 3 = 0 THEN 'fallback' ELSE 'abort' END AS on_failure", "CASE WHEN step % 2 = 1 THEN 'x' END AS fallback")
    return dag.check_dag(steps.unionByName(edges.where("depends_on = 0").selectExpr("0L AS step", "'abort' AS on_failure", "CAST(NULL AS STRING) AS fallback").distinct()), edges)


@query(
    "i10_lineage", "operator_actions",
    """WITH RECURSIVE a AS (SELECT id, from_event FROM operator_actions), r(node, root, depth) AS (
         SELECT id, id, CAST(0 AS BIGINT) FROM a WHERE from_event IS NULL UNION ALL SELECT a.id, r.root, r.depth + 1 FROM r JOIN a ON a.from_event = r.node)
       SELECT node, root, depth FROM r""",
)
def _(actions):
    return dag.lineage(actions, "id", "from_event")


@query(
    "i11_pipeline", "tasks task_runs",
    """SELECT capability, count(*) AS failed_runs FROM tasks JOIN task_runs r USING (task_id) WHERE r.status = 'failed' GROUP BY 1""",
)
def _(tasks, runs):
    p = dag.Pipeline()

    @p.step("report", "joined")
    def _report(joined):
        return joined.groupBy("capability").agg(F.count("*").alias("failed_runs"))

    @p.step("joined", "tasks", "failed")
    def _joined(tasks, failed):
        return tasks.select("task_id", "capability").join(failed, "task_id")

    @p.step("failed", "runs")
    def _failed(runs):
        return runs.where("status = 'failed'").select("task_id")

    return p.run({"tasks": tasks, "runs": runs})["report"]


@query("u2_deps_done", "dag_steps", "SELECT step, max(depends_on) <= 100 AS ready FROM dag_steps GROUP BY step")
def _(edges):
    deps = edges.groupBy("step").agg(F.collect_set("depends_on").alias("depends"))
    return deps.select("step", (F.size(F.array_except("depends", F.sequence(F.lit(0).cast("long"), F.lit(100).cast("long")))) == 0).alias("ready"))


@query(
    "u2_deps_done_table", "lineitem dag_steps",
    """WITH done AS (SELECT DISTINCT l_suppkey AS run_id, l_partkey AS step FROM lineitem UNION SELECT DISTINCT l_suppkey, 0 FROM lineitem), near AS (SELECT DISTINCT run_id, d.step FROM done JOIN dag_steps d ON d.depends_on = done.step),
       lacks AS (SELECT n.run_id, n.step FROM near n JOIN dag_steps d USING (step) ANTI JOIN done ON done.run_id = n.run_id AND done.step = d.depends_on)
       SELECT run_id, step FROM near EXCEPT SELECT run_id, step FROM lacks EXCEPT SELECT run_id, step FROM done""",
)
def _(lines, edges):
    runs = lines.selectExpr("CAST(l_suppkey AS BIGINT) AS run_id")
    done = lines.selectExpr("CAST(l_suppkey AS BIGINT) AS run_id", "CAST(l_partkey AS BIGINT) AS step").unionByName(runs.selectExpr("run_id", "0L AS step"))
    return dag.ready_after(_steps(edges), edges, runs, done, done.limit(0))
