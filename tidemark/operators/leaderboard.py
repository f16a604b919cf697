"""Benchmark leaderboard: one row per (model, task) trial in, boards and statistics out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import stored
from .ranks import lower_median, with_global_rank

# Pass thresholds, reward bands (upper bounds), and the uniform run budget.
THRESHOLDS = (0.90, 0.95, 1.00)
REWARD_BANDS = (("(0,.25)", 0.25), ("[.25,.5)", 0.50), ("[.5,.75)", 0.75), ("[.75,.95)", 0.95))
BUDGET_SECONDS = 5400.0
TIMEOUT_MULTIPLIER = 1.0


def _effective() -> Column:
    """Reward with errored trials scored zero."""
    return F.when(F.coalesce("errored", F.lit(False)) | F.col("reward").isNull(), F.lit(0.0)).otherwise(F.col("reward"))


def average_attempts(attempts: DataFrame, keys: Sequence[str] = ("model", "org", "task", "category")) -> DataFrame:
    """One trial per model and task from any number of attempts.

    ``reward`` is the mean over attempts, errored ones counting as zero; a trial is ``errored`` when all of
    its attempts are. ``cost``, ``steps`` and ``minutes`` are means. Sums are taken over decimals, so the
    order of rows cannot change them.
    """
    mean = lambda c, digits: F.round(F.sum(c.cast(f"decimal(28,{digits})")).cast("double") / F.count("*"), 9)
    return attempts.groupBy(*keys).agg(
        mean(_effective(), 6).alias("reward"),
        F.every(F.coalesce("errored", F.lit(False))).alias("errored"),
        *[mean(F.col(c), 6).alias(c) for c in ("cost", "steps", "minutes")],
        F.count("*").alias("attempts"),
    )


def mean_reward(trials: DataFrame, n_tasks: int) -> DataFrame:
    """Mean over the full task list; errored and missing trials count as zero."""
    return trials.groupBy("model", "org").agg(
        (F.sum(_effective()) / F.lit(n_tasks)).alias("mean_reward"),
        F.count("*").alias("trials"),
        F.count_if(F.coalesce("errored", F.lit(False))).alias("errors"),
    )


def pass_name(threshold: float) -> str:
    return f"pass_{round(threshold * 100):d}"


def pass_counts(trials: DataFrame, n_tasks: int, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Passes and pass rates per model at each reward threshold."""
    counts = [F.count_if(_effective() >= t).alias(pass_name(t)) for t in thresholds]
    rates = [(F.col(pass_name(t)) / F.lit(n_tasks)).alias(f"rate_{round(t * 100):d}") for t in thresholds]
    return trials.groupBy("model", "org").agg(*counts).select("*", *rates)


def board(trials: DataFrame, n_tasks: int, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """One row per model: mean reward, passes per threshold, mean cost."""
    return trials.groupBy("model", "org").agg(
        (F.sum(_effective()) / F.lit(n_tasks)).alias("mean_reward"),
        *[F.count_if(_effective() >= t).alias(pass_name(t)) for t in thresholds],
        F.avg("cost").alias("cost"),
    )


def _ranking(by: str, passes: str) -> Column:
    mean, passed = -F.round("mean_reward", 9), -F.col(passes)
    first, second = (passed, mean) if by == "pass" else (mean, passed)
    return F.struct(first.alias("a"), second.alias("b"), F.col("model").alias("c"))


def leaderboard(rows: DataFrame, n_tasks: int, by: str = "mean", threshold: float = 0.95) -> DataFrame:
    """Rank by mean then passes, or by passes then mean; with the share of the leader's value."""
    passes = pass_name(threshold)
    value = F.col(passes) / F.lit(n_tasks) if by == "pass" else F.col("mean_reward")
    leader = rows.agg(F.greatest(F.max(value), F.lit(1e-6)).alias("m")).scalar()
    return with_global_rank(rows, _ranking(by, passes)).withColumn("leader_share", value / leader)


def community_board(
    rows: DataFrame, filters: dict[str, object] | None = None, by: str = "pass", threshold: float = 0.95
) -> DataFrame:
    """Board with ranks assigned before the filters, so filtered rows keep their global rank."""
    ranked = with_global_rank(rows, _ranking(by, pass_name(threshold)))
    for column, value in (filters or {}).items():
        if value not in (None, "", False):
            ranked = ranked.where(F.col(column) == value)
    return ranked


def reward_bands(trials: DataFrame) -> DataFrame:
    """Runs and share of all runs per reward band."""
    reward = _effective()
    band = F.when(reward <= 0, F.lit("0"))
    for name, upper in REWARD_BANDS:
        band = band.when(reward < upper, F.lit(name))
    counts = trials.groupBy(band.otherwise(F.lit(">=.95")).alias("band")).agg(F.count("*").alias("runs"))
    total = trials.agg(F.count("*").alias("n")).scalar()
    return counts.withColumn("share", F.round(100.0 * F.col("runs") / total, 1))


def hardest_tasks(trials: DataFrame, k: int = 8) -> DataFrame:
    """Tasks of lowest mean reward with the best single run."""
    per_task = trials.groupBy("task", "category").agg(
        F.avg(_effective()).alias("mean_reward"), F.max(_effective()).alias("best_reward")
    )
    return per_task.orderBy(F.round("mean_reward", 9), "task").limit(k)


def frontier(trials: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Tasks solved by at least one model and tasks solved by none."""
    best = trials.groupBy("task").agg(F.max(_effective()).alias("best"))
    return best.agg(
        F.count("*").alias("tasks"),
        F.count_if(F.col("best") >= threshold).alias("solved"),
        F.count_if(F.col("best") < threshold).alias("unsolved"),
    )


def horizon(trials: DataFrame) -> DataFrame:
    """Mean steps and minutes per task and hours of one full pass, per model."""
    return trials.groupBy("model", "org").agg(
        F.avg("steps").alias("mean_steps"),
        F.avg("minutes").alias("mean_minutes"),
        (F.sum("minutes") / 60.0).alias("total_hours"),
    )


def task_domains(trials: DataFrame) -> DataFrame:
    """Distinct tasks per category."""
    return trials.groupBy("category").agg(F.countDistinct("task").alias("tasks"))


def cost_summary(rows: DataFrame, n_tasks: int, threshold: float = 0.95) -> DataFrame:
    """Average cost, reward and pass rate over models, and the lower median of the known costs.

    The board is stored once as three numbers per model; the median is selected by counting.
    """
    board = stored(rows.select("cost", "mean_reward", F.col(pass_name(threshold)).alias("passes")), "costs")
    averages = board.agg(
        F.count("*").alias("models"),
        F.avg("cost").alias("avg_cost"),
        F.avg("mean_reward").alias("avg_reward"),
        (F.avg("passes") / F.lit(n_tasks)).alias("avg_pass_rate"),
    )
    return averages.withColumn("median_cost", F.lit(lower_median(board, "cost")).cast("double"))


def validate_submission(trials: DataFrame, tasks: DataFrame) -> DataFrame:
    """Violations per model: (model, task, violation).

    One trial per task, every task present, the uniform budget, multiplier 1.0, no resource
    override, and a result for every trial.
    """
    rules = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("budget_seconds") == BUDGET_SECONDS, F.lit(False)), F.lit("wrong budget")),
            F.when(~F.coalesce(F.col("timeout_multiplier") == TIMEOUT_MULTIPLIER, F.lit(False)), F.lit("wrong multiplier")),
            F.when(F.coalesce("resource_override", F.lit(False)), F.lit("resource override")),
            F.when(~F.coalesce("has_result", F.lit(False)), F.lit("missing result")),
        )
    )
    per_trial = trials.select("model", "task", F.explode(rules).alias("violation"))
    counted = trials.groupBy("model", "task").agg(F.count("*").alias("n"))
    repeated = counted.where("n > 1").select("model", "task", F.lit("several trials").alias("violation"))
    # A model's list holds at most the suite's tasks, however many trials it has.
    suite = tasks.agg(F.collect_set("task").alias("t")).scalar()
    known = counted.join(tasks.select("task").distinct(), "task", "left_semi")
    have = known.groupBy("model").agg(F.collect_set("task").alias("_have"))
    missing = (
        trials.select("model").distinct().join(have, "model", "left")
        .withColumn("_missing", F.when(F.col("_have").isNull(), suite).otherwise(F.array_except(suite, F.col("_have"))))
        .select("model", F.explode("_missing").alias("task"), F.lit("missing task").alias("violation"))
    )
    unknown = counted.join(tasks.select("task").distinct(), "task", "left_anti").select(
        "model", "task", F.lit("unknown task").alias("violation")
    )
    return per_trial.unionByName(repeated).unionByName(missing).unionByName(unknown)


def run_listing(rows: DataFrame, by: str = "reward") -> DataFrame:
    """Named runs by reward, best first, or by name."""
    order = [F.col("model"), F.col("task")] if by == "name" else [F.desc("reward"), F.col("model"), F.col("task")]
    return rows.orderBy(*order)
