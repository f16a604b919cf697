"""Queries over the trials view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import leaderboard as lb
from . import views as v
from .views import BOARD_SQL, N_TASKS, TRIALS_SQL

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def _board(spark, sf):
    return lb.board(v.trials(spark, sf), N_TASKS)


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"""WITH {TRIALS_SQL}
SELECT model, org, round(sum(eff) / {N_TASKS}, 6) AS mean_reward, count(*) AS trials, count(*) FILTER (WHERE errored) AS errors
FROM effective GROUP BY 1, 2""")
def l1_mean_reward(spark, sf):
    return _rounded(lb.mean_reward(v.trials(spark, sf), N_TASKS), "mean_reward")


@query(f"""WITH {BOARD_SQL}
SELECT model, org, pass_90, pass_95, pass_100, round(pass_90 / {N_TASKS}, 6) AS rate_90, round(pass_95 / {N_TASKS}, 6) AS rate_95,
  round(pass_100 / {N_TASKS}, 6) AS rate_100 FROM board""")
def l2_pass_counts(spark, sf):
    return _rounded(lb.pass_counts(v.trials(spark, sf), N_TASKS), "rate_90", "rate_95", "rate_100")


_RANKED = """row_number() OVER (ORDER BY round(mean_reward, 9) DESC, pass_95 DESC, model) AS rank"""
_RANKED_PASS = """row_number() OVER (ORDER BY pass_95 DESC, round(mean_reward, 9) DESC, model) AS rank"""


@query(f"""WITH {BOARD_SQL}
SELECT model, org, {_RANKED}, pass_95, round(mean_reward / greatest((SELECT max(mean_reward) FROM board), 1e-6), 6) AS leader_share FROM board""")
def l3_leaderboard_by_mean(spark, sf):
    ranked = lb.leaderboard(_board(spark, sf), N_TASKS)
    return _rounded(ranked.select("model", "org", "rank", "pass_95", "leader_share"), "leader_share")


@query(f"""WITH {BOARD_SQL}
SELECT model, org, {_RANKED_PASS}, pass_95, round(pass_95 / greatest((SELECT max(pass_95) FROM board), 1e-6), 6) AS leader_share FROM board""")
def l3_leaderboard_by_pass(spark, sf):
    ranked = lb.leaderboard(_board(spark, sf), N_TASKS, by="pass")
    return _rounded(ranked.select("model", "org", "rank", "pass_95", "leader_share"), "leader_share")


@query(f"""WITH {BOARD_SQL}, ranked AS (SELECT *, {_RANKED_PASS} FROM board)
SELECT model, org, rank, pass_95, round(mean_reward, 6) AS mean_reward FROM ranked WHERE org = 'NATION_7'""")
def l4_community_board(spark, sf):
    shown = lb.community_board(_board(spark, sf), {"org": "NATION_7", "model": ""})
    return _rounded(shown.select("model", "org", "rank", "pass_95", "mean_reward"), "mean_reward")


@query(f"""WITH {TRIALS_SQL}
SELECT CASE WHEN eff <= 0 THEN '0' WHEN eff < 0.25 THEN '(0,.25)' WHEN eff < 0.5 THEN '[.25,.5)' WHEN eff < 0.75 THEN '[.5,.75)'
  WHEN eff < 0.95 THEN '[.75,.95)' ELSE '>=.95' END AS band, count(*) AS runs,
  round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM effective), 1) AS share FROM effective GROUP BY 1""")
def l5_reward_bands(spark, sf):
    return lb.reward_bands(v.trials(spark, sf))


@query(f"""WITH {TRIALS_SQL}
SELECT task, category, round(avg(eff), 6) AS mean_reward, max(eff) AS best_reward FROM effective GROUP BY 1, 2
ORDER BY round(avg(eff), 9), task LIMIT 8""")
def l6_hardest_tasks(spark, sf):
    return _rounded(lb.hardest_tasks(v.trials(spark, sf)), "mean_reward")


@query(f"""WITH {TRIALS_SQL}, best AS (SELECT task, max(eff) AS b FROM effective GROUP BY 1)
SELECT count(*) AS tasks, count(*) FILTER (WHERE b >= 0.95) AS solved, count(*) FILTER (WHERE b < 0.95) AS unsolved FROM best""")
def l7_frontier(spark, sf):
    return lb.frontier(v.trials(spark, sf))


@query(f"""WITH {TRIALS_SQL}
SELECT model, org, round(avg(steps), 6) AS mean_steps, round(avg(minutes), 6) AS mean_minutes, round(sum(minutes) / 60.0, 6) AS total_hours
FROM trials GROUP BY 1, 2""")
def l8_horizon(spark, sf):
    return _rounded(lb.horizon(v.trials(spark, sf)), "mean_steps", "mean_minutes", "total_hours")


@query(f"WITH {TRIALS_SQL} SELECT category, count(DISTINCT task) AS tasks FROM trials GROUP BY 1")
def l9_task_domains(spark, sf):
    return lb.task_domains(v.trials(spark, sf))


@query(f"""WITH {BOARD_SQL}
SELECT count(*) AS models, round(avg(cost), 6) AS avg_cost, round(avg(mean_reward), 6) AS avg_reward,
  round(avg(pass_95) / {N_TASKS}, 6) AS avg_pass_rate,
  (SELECT round(cost, 6) FROM (SELECT cost, row_number() OVER (ORDER BY cost, model) AS rn FROM board)
   WHERE rn = (SELECT (count(*) + 1) // 2 FROM board)) AS median_cost FROM board""")
def l10_cost_summary(spark, sf):
    summary = lb.cost_summary(_board(spark, sf), N_TASKS)
    return _rounded(summary, "avg_cost", "avg_reward", "avg_pass_rate", "median_cost")


@query(f"""WITH lines AS (
  SELECT l_suppkey AS model, l_partkey % {N_TASKS} AS task, CASE WHEN l_tax = 0.08 THEN 7200.0 ELSE 5400.0 END AS budget,
    CASE WHEN l_linestatus = 'F' AND l_quantity = 50 THEN 2.0 ELSE 1.0 END AS mult, l_quantity = 49 AS over, l_quantity <> 48 AS res
  FROM lineitem WHERE l_suppkey % 2 = 0 OR l_partkey % {N_TASKS} <> 3),
tasks AS (SELECT DISTINCT p_partkey % {N_TASKS} AS task FROM part WHERE p_partkey % {N_TASKS} <> 5)
SELECT violation, count(*) AS rows, count(DISTINCT model) AS models FROM (
  SELECT model, 'wrong budget' AS violation FROM lines WHERE budget <> 5400
  UNION ALL SELECT model, 'wrong multiplier' FROM lines WHERE mult <> 1.0
  UNION ALL SELECT model, 'resource override' FROM lines WHERE over
  UNION ALL SELECT model, 'missing result' FROM lines WHERE NOT res
  UNION ALL SELECT model, 'several trials' FROM lines GROUP BY model, task HAVING count(*) > 1
  UNION ALL SELECT m.model, 'missing task' FROM (SELECT DISTINCT model FROM lines) m CROSS JOIN tasks t
    WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.model = m.model AND l.task = t.task)
  UNION ALL SELECT model, 'unknown task' FROM lines WHERE task NOT IN (SELECT task FROM tasks) GROUP BY model, task
) GROUP BY 1""")
def l11_validate_submission(spark, sf):
    """Violations by kind; odd models lack task 3, and task 5 is not in the suite."""
    lines = v.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("model"), (F.col("l_partkey") % N_TASKS).alias("task"),
        F.when(F.col("l_tax") == 0.08, 7200.0).otherwise(5400.0).alias("budget_seconds"),
        F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") == 50), 2.0).otherwise(1.0).alias("timeout_multiplier"),
        (F.col("l_quantity") == 49).alias("resource_override"), (F.col("l_quantity") != 48).alias("has_result"),
    ).where((F.col("model") % 2 == 0) | (F.col("task") != 3))
    suite = v.table(spark, sf, "part").select((F.col("p_partkey") % N_TASKS).alias("task")).where("task <> 5").distinct()
    found = lb.validate_submission(lines, suite)
    return found.groupBy("violation").agg(F.count("*").alias("rows"), F.countDistinct("model").alias("models"))


@query(f"WITH {TRIALS_SQL} SELECT model, task, reward, floor(cost * 1e6) / 1e6 AS cost FROM trials")
def l12_run_listing(spark, sf):
    listed = lb.run_listing(v.trials(spark, sf))
    # Cut, not rounded: the two engines round exact halves apart.
    return listed.select("model", "task", "reward", (F.floor(F.col("cost") * 1e6) / 1e6).alias("cost"))
