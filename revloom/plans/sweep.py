"""Experiments: one metrics table over vector widths, community numbers and models."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor, as_completed

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import Estimator
from pyspark.sql import DataFrame, SparkSession

from revloom.operators.evaluate import METRIC_ROW, evaluate, sum_pairs
from revloom.operators.forests import Forest, fit_forests, score_forests
from revloom.operators.regression import (
    BLENDED,
    blended_test,
    fit_estimator_by_community,
    fit_predict,
    fit_predict_by_community,
    linear_regression,
    training_rows,
)
from revloom.session import pin, unpin
from revloom.sources.writers import append_metrics

RIDGE = "ridge"
METRICS = 3  # rows of a setting


def sweep(
    vectors: Callable[[int], DataFrame],
    memberships: Mapping[int | None, DataFrame | None],
    ks: Sequence[int],
    models: Mapping[str, Estimator | Forest | str],
    mode: str = "l2sum",
    reg_param: float = 0.01,
    run_id: str = "sweep",
    profile_from: str = "all",
    keep: Callable[[DataFrame, int, int | None, str], DataFrame] | None = None,
    log: str | None = None,
    parallelism: int = 2,
) -> DataFrame:
    """Metric rows ``(run_id, k, c, model, metric, value)`` for every setting.

    ``vectors(k)`` gives split review vectors. ``memberships`` maps the number of communities to
    ``(user_id, community_id)``; ``None`` stands for the global model. A model is an estimator, a
    ``Forest`` or ``RIDGE``; the latter two take all communities at once. Settings are few, rows
    are many: each setting is a few distributed jobs, and three numbers per setting come back.
    Reviews and blend of a width are written once for its settings, of which ``parallelism`` run side by side,
    each in a scheduler pool of its own (which shares the cluster evenly under ``spark.scheduler.mode=FAIR``).
    ``keep`` gets the pair sums of every setting with ``k``, ``c`` and the model's
    name, may write them, and gives back what is evaluated. ``log`` names a metrics log: a setting's rows are added
    to it as soon as they are there, and settings of this ``run_id`` that it already holds are not run again.
    """
    if not ks:
        raise ValueError("ks is empty")
    spark = SparkSession.active()
    rows: list[tuple] = []
    for k in ks:
        settings = [(c, name) for c in memberships for name in models]
        done = _logged(spark, log, run_id, k)
        rows += [row for key in settings if key in done for row in done[key]]
        todo = [key for key in settings if key not in done]
        if todo:
            rows += _settings(spark, vectors(k), memberships, k, models, todo, mode, reg_param, run_id, profile_from, keep, log, parallelism)
    return spark.createDataFrame(rows, METRIC_ROW)


def _logged(spark: SparkSession, log: str | None, run_id: str, k: int) -> dict[tuple, list[tuple]]:
    """Rows of finished settings by community number and model; an unfinished one is none."""
    if log is None:
        return {}
    try:
        held = spark.read.schema(METRIC_ROW).parquet(log)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    found: dict[tuple, dict[str, tuple]] = {}
    for r in held.where((held.run_id == run_id) & (held.k == k)).collect():  # a few rows a setting
        found.setdefault((r["c"], r["model"]), {})[r["metric"]] = tuple(r)
    return {key: list(rows.values()) for key, rows in found.items() if len(rows) == METRICS}


def _score(reviews, blended, membership, estimator, k, mode, reg_param) -> DataFrame:
    """Pair sums of one setting."""
    if isinstance(estimator, Forest):
        nodes = fit_forests(training_rows(reviews, mode), k, estimator, membership)
        return sum_pairs(score_forests(blended, nodes, membership))
    if membership is None:
        chosen = linear_regression(reg_param) if estimator == RIDGE else estimator
        return fit_predict(reviews, chosen, k, mode, blended=blended)[0]
    if estimator == RIDGE:
        return fit_predict_by_community(reviews, membership, k, reg_param, mode, blended=blended)[0]
    return sum_pairs(fit_estimator_by_community(reviews, membership, estimator, k, mode, blended=blended)[0])


def _settings(spark, reviews, memberships, k, models, todo, mode, reg_param, run_id, profile_from, keep, log, parallelism) -> list[tuple]:
    """Metric rows of the given models and communities for one width."""
    reviews = pin(reviews)
    # The blend does not depend on the model or the communities.
    blended = pin(blended_test(reviews, mode, k, profile_from).select(*BLENDED))

    def run(c: int | None, name: str) -> list[tuple]:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{run_id}-{k}-{c}-{name}")
        scored = _score(reviews, blended, memberships[c], models[name], k, mode, reg_param)
        if keep is not None:
            scored = keep(scored, k, c, name)
        return [tuple(r) for r in evaluate(scored, run_id, k, c, name).collect()]

    rows: list[tuple] = []
    with ThreadPoolExecutor(max(parallelism, 1)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(run), c, name) for c, name in todo]
        for ended in as_completed(running):
            rows += ended.result()
            if log is not None:
                append_metrics(spark.createDataFrame(ended.result(), METRIC_ROW), log)
    unpin(spark, reviews, blended)
    return rows
