"""Queries that fit models: their scores, and facts about them that SQL can state too."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lifespan.config import Boosting
from lifespan.fixed_values import MEMBER_SEEDS
from lifespan.functions import scalar as sc
from lifespan.operators import evaluate, experts, features, rules, split
from lifespan.operators.segments import all_of
from lifespan.plans import scoring
from lifespan.plans.registry import STEPS, query
from lifespan.plans.score_queries import PLAN, flagship_steps
from lifespan.sources import tables as tb
from lifespan.sources.storage import cut_lineage

SMALL = Boosting(8, 8, 32, 5, 0.2, 0.0)
RMAX = 20.0


def labelled_windows(spark, base):
    """Feature windows of the event steps with their split and a capped label."""
    axis = tb.event_axis(spark, base)
    w = scoring.window_features(flagship_steps(spark, base, axis), PLAN, ["t", "age", "age_scale", "y_true"], axis)
    out = w.select(
        "unit_id", "window_index", F.col("t").alias("t_end"), "age", "age_scale", F.least("y_true", F.lit(RMAX)).alias("y_true"),
        features.statistic_major().alias("tree_x"),
        features.direct_features("age", F.col("age_scale")).alias("direct_x"),
        features.invariant_features("age", F.col("age_scale"), 3).alias("invariant_x"),
        F.when(split.digest(0) < "d", "train").otherwise("val").alias("split"),
    )
    return cut_lineage(out)


_WINDOWS_SQL = "WITH" + STEPS + """,
w AS (SELECT unit_id, CASE WHEN sha256('0:' || unit_id) < 'd' THEN 'train' ELSE 'val' END AS split FROM st WHERE step >= 15 AND (step - 15) % 4 = 0)"""


def _facts_sql(name: str, seeds=("",)) -> str:
    experts_ = ", ".join(f"'{name}{s}'" for s in seeds)
    return _WINDOWS_SQL + f""" SELECT expert, split, count(*) AS n_windows, count(DISTINCT unit_id) AS n_units, count(*) AS n_finite,
 CASE WHEN split = 'train' THEN true END AS beats_mean FROM w CROSS JOIN (SELECT unnest([{experts_}]) AS expert) GROUP BY 1, 2"""


def expert_facts(scored, names):
    """Per expert and split: windows, units, finite scores; on training rows, whether the error is below that of their mean."""
    long = scored.select("unit_id", "split", "y_true", *names).unpivot(["unit_id", "split", "y_true"], names, "expert", "y_norm")
    error = F.sqrt(F.avg((RMAX * F.col("y_norm") - F.col("y_true")) ** 2))
    return long.groupBy("expert", "split").agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.count_distinct("unit_id").alias("n_units"),
        F.count_if(sc.finite(F.col("y_norm"))).alias("n_finite"),
        F.when(F.col("split") == "train", error < F.stddev_pop("y_true")).alias("beats_mean"),
    )


def _tree(w):
    model = experts.fit_tree_expert(w.where("split = 'train'"), "tree_x", "y_true", RMAX, SMALL)
    return experts.score(w, model, "tree_x", "tree")


def _direct(w):
    for seed in MEMBER_SEEDS:
        model = experts.fit_direct_expert(w.where("split = 'train'"), w.where("split = 'val'"), "direct_x", "y_true", RMAX, seed, 8)
        w = experts.score(w, model, "direct_x", f"direct{seed}")
    return w


def _shared(w):
    model = experts.fit_shared_expert(w.where("split = 'train'"), "invariant_x", "y_true", RMAX)
    return experts.score(w, model, "invariant_x", "shared")


@query("m01_tree_expert")
def tree_expert(spark, base):
    return _tree(labelled_windows(spark, base)).select("unit_id", "window_index", "split", F.col("tree").alias("y_norm"))


@query("m01_tree_facts", _facts_sql("tree"))
def tree_facts(spark, base):
    return expert_facts(_tree(labelled_windows(spark, base)), ["tree"])


@query("m02_direct_expert")
def direct_expert(spark, base):
    w = _direct(labelled_windows(spark, base))
    return w.select("unit_id", "window_index", *[F.col(f"direct{s}").alias(f"m{s}") for s in MEMBER_SEEDS])


@query("m02_direct_facts", _facts_sql("direct", MEMBER_SEEDS))
def direct_facts(spark, base):
    return expert_facts(_direct(labelled_windows(spark, base)), [f"direct{s}" for s in MEMBER_SEEDS])


@query("m03_shared_expert")
def shared_expert(spark, base):
    return _shared(labelled_windows(spark, base)).select("unit_id", "window_index", F.col("shared").alias("y_norm"))


@query("m03_shared_facts", _facts_sql("shared"))
def shared_facts(spark, base):
    return expert_facts(_shared(labelled_windows(spark, base)), ["shared"])


@query("m04_score_external", """WITH s AS (SELECT vec_id AS unit_id, list_avg(CAST(embedding AS DOUBLE[])) AS m FROM embeddings) SELECT unit_id, round(m, 9) AS y_norm FROM s""")
def score_external(spark, base):
    def predict(batches):
        for batch in batches:
            yield batch[["unit_id"]].assign(y_norm=np.stack(batch["flat"]).mean(axis=1))

    w = tb.embedding_windows(spark, base).select("unit_id", F.flatten("x").alias("flat"))
    out = experts.score_external(w, predict, "unit_id long, y_norm double")
    return out.select("unit_id", F.round("y_norm", 9).alias("y_norm"))


@query("m09_refit_plan")
def refit_plan(spark, base):
    w = labelled_windows(spark, base)
    train, val = w.where("split = 'train'"), w.where("split = 'val'")
    selection, final, _ = experts.refit_plan(train, val, "direct_x", "tree_x", "y_true", RMAX, SMALL, 6)
    parts = []
    for stage, members, rows in (("selection", selection, val), ("final", final, w)):
        scored = scoring.score(rows, PLAN, members.predictor("tree_x", "direct_x"))
        metrics = evaluate.regression_metrics(scored, scoring.WINDOW_AXIS)
        parts.append(metrics.withColumn("stage", F.lit(stage)))
    return parts[0].unionByName(parts[1])


@query(
    "m09_refit_facts",
    _WINDOWS_SQL + """, u AS (SELECT count(DISTINCT unit_id) FILTER (split = 'train') AS a, count(DISTINCT unit_id) FILTER (split = 'val') AS b FROM w)
SELECT stage, n_windows, n_units, n_windows AS n_finite, true AS rounds_as_planned, CAST(0 AS BIGINT) AS n_shared_units FROM (
 SELECT 'selection' AS stage, count(*) FILTER (split = 'val') AS n_windows, any_value(b) AS n_units FROM w CROSS JOIN u
 UNION ALL SELECT 'final', count(*), any_value(a + b) FROM w CROSS JOIN u)""",
)
def refit_facts(spark, base):
    w = labelled_windows(spark, base)
    train, val = w.where("split = 'train'"), w.where("split = 'val'")
    selection, final, chosen = experts.refit_plan(train, val, "direct_x", "tree_x", "y_true", RMAX, SMALL, 6)
    frozen = sorted(chosen.values())[1]
    planned = {"selection": chosen, "final": dict.fromkeys(MEMBER_SEEDS, frozen)}
    shared = rules.split_overlap(train, val).agg(F.count(F.lit(1)).alias("n_shared_units"))
    parts = []
    for stage, members, rows in (("selection", selection, val), ("final", final, w)):
        scored = members.predictor("tree_x", "direct_x")(rows)
        whole = all_of([sc.finite(F.col(f"{kind}_{s}")) for s in MEMBER_SEEDS for kind in ("direct", "tree")])
        kept = {s: m.getNumTrees for s, m in members.direct.items()} == planned[stage]
        parts.append(
            scored.agg(F.count(F.lit(1)).alias("n_windows"), F.count_distinct("unit_id").alias("n_units"), F.count_if(whole).alias("n_finite"))
            .select(F.lit(stage).alias("stage"), "*", F.lit(kept).alias("rounds_as_planned"), shared.scalar().alias("n_shared_units"))
        )
    return parts[0].unionByName(parts[1])
