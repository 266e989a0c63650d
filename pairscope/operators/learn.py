"""Linear risk models and calibration for every rotation and variant at once.

All models of a call take their Newton steps together: one aggregate over the rows gives each model's gradient and normal
equations, keyed by model. Only these sums, a square of the feature count per model, reach the driver, which solves for the steps;
the models' number is set by the study (rotations x variants), not by the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from pairscope.session import cut_lineage

FOLDS = 5
#: Weight of the squared coefficients beside the mean loss, on standardised features.
RIDGE = 1e-4
TOLERANCE, ROUNDS = 1e-10, 60
POOLED_AWARE, POOLED_AGNOSTIC = "POOLED_SOURCE_AWARE", "POOLED_SOURCE_AGNOSTIC"
SPECIFIC, HELD_OUT = "MODEL_SPECIFIC_", "LOMO_HOLDOUT_"


def stable_sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def _linear(names: Sequence[str], beta: str) -> Column:
    return reduce(add, [F.col(beta)[k + 1] * F.col(n) for k, n in enumerate(names)], F.col(beta)[0])


def _table(rows: DataFrame, keys: Sequence[str], models: dict[tuple, np.ndarray], name: str) -> DataFrame:
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.sparkSession.createDataFrame([(*k, [float(v) for v in b]) for k, b in models.items()], f"{kinds}, {name} array<double>")


def grouped_logistic(rows: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, weight: str | None = None,
                     ridge: float = 0.0, start: dict[tuple, np.ndarray] | None = None) -> dict[tuple, np.ndarray]:
    """Per key: intercept and coefficients that minimise the weighted mean log loss plus ``ridge`` / 2 x squared coefficients.

    Newton steps, halved for a model whose loss would rise. Each model needs both classes; a model that does not settle is an error.
    """
    keys, features = list(keys), list(features)
    thin = cut_lineage(rows.select(
        *keys, *[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("_y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w")))
    seen = thin.groupBy(*keys).agg(F.sum("_w").alias("_n"), F.sum(F.col("_w") * F.col("_y")).alias("_pos"), F.count_distinct("_y").alias("_classes")).collect()
    if any(r["_classes"] != 2 for r in seen):
        raise ValueError("a model's rows hold one class only")
    share = {tuple(r[k] for k in keys): r["_pos"] / r["_n"] for r in seen}
    d = len(features) + 1
    current = start or {k: np.r_[np.log(p / (1 - p)), np.zeros(d - 1)] for k, p in share.items()}
    x = [F.lit(1.0), *[F.col(f) for f in features]]
    cells = [(i, j) for i in range(d) for j in range(i, d)]
    z = _linear(features, "_b")
    p, w, y = stable_sigmoid(z), F.col("_w"), F.col("_y")
    loss = w * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - y * z)

    def measured(models: dict[tuple, np.ndarray]) -> dict[tuple, tuple[float, np.ndarray, np.ndarray]]:
        scored = thin.join(_table(thin, keys, models, "_b"), keys)
        sums = scored.groupBy(*keys).agg(
            F.sum(w).alias("_n"), F.sum(loss).alias("_loss"), F.array(*[F.sum(w * (p - y) * c) for c in x]).alias("_g"),
            F.array(*[F.sum(w * p * (1 - p) * x[i] * x[j]) for i, j in cells]).alias("_h"))
        out = {}
        for r in sums.collect():
            key = tuple(r[k] for k in keys)
            beta, hessian = models[key].copy(), np.zeros((d, d))
            for (i, j), v in zip(cells, r["_h"]):
                hessian[i, j] = hessian[j, i] = v / r["_n"]
            beta[0] = 0.0
            penalty = np.diag(np.r_[0.0, np.full(d - 1, ridge)])
            out[key] = r["_loss"] / r["_n"] + ridge / 2 * float(beta @ beta), np.array(r["_g"]) / r["_n"] + ridge * beta, hessian + penalty
        return out

    state = measured(current)
    done: dict[tuple, np.ndarray] = {}
    for _ in range(ROUNDS):
        steps = {k: np.linalg.lstsq(h, g, rcond=None)[0] for k, (_, g, h) in state.items()}
        done |= {k: current[k] - s for k, s in steps.items() if np.abs(s).max() <= TOLERANCE * (1 + np.abs(current[k]).max())}
        open_models = {k: s for k, s in steps.items() if k not in done}
        if not open_models:
            return done
        scale = dict.fromkeys(open_models, 1.0)
        while True:
            tried = {k: current[k] - scale[k] * s for k, s in open_models.items()}
            after = measured(tried)
            worse = [k for k in open_models if not after[k][0] <= state[k][0] + 1e-12 and scale[k] > 1e-6]
            if not worse:
                break
            for k in worse:
                scale[k] /= 2
        current, state = current | tried, after
    raise RuntimeError("a model did not settle; its classes may be separable")


def roles(rows: DataFrame, fold: str = "fold") -> DataFrame:
    """Each row once per rotation, with ``rotation`` and ``role``: test, validation (the next fold) or train."""
    turned = rows.withColumn("rotation", F.explode(F.array(*[F.lit(r) for r in range(FOLDS)])))
    return turned.withColumn("role", F.when(F.col(fold) == F.col("rotation"), "test").when(
        F.col(fold) == (F.col("rotation") + 1) % FOLDS, "validation").otherwise("train"))


def variants(rows: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Each row once per variant it takes part in: ``variant``, ``trains`` and ``scored`` (the held-out source is scored only)."""
    source = F.col("source")
    parts = [F.struct(F.lit(name).alias("variant"), F.lit(True).alias("trains"), F.lit(True).alias("scored")) for name in (POOLED_AWARE, POOLED_AGNOSTIC)]
    for s in sources:
        parts.append(F.when(source == s, F.struct(F.lit(SPECIFIC + s.upper()).alias("variant"), F.lit(True).alias("trains"), F.lit(True).alias("scored"))))
        parts.append(F.struct(F.lit(HELD_OUT + s.upper()).alias("variant"), (source != s).alias("trains"), (source == s).alias("scored")))
    return rows.withColumn("_v", F.explode(F.array_compact(F.array(*parts)))).select(*rows.columns, "_v.*")


def fit_delete_risk(rows: DataFrame, columns: Sequence[str], sources: Sequence[str]) -> DataFrame:
    """(variant, rotation, row) with ``p_delete`` of every row in its own test fold, for every variant that scores it.

    Features are standardised on the training rows of their model (deviation at least 1e-8); deletions weigh KEEP / DELETE of those
    rows; only the source-aware variant sees the source. ``rows`` has fold, source, label_delete and the columns. Rows that agree in
    all of these are one weighted row before they are dealt to models, so a Newton step reads distinct feature rows, not events.
    """
    keys, columns = ["variant", "rotation"], list(columns)
    known = [f"_is_{s}" for s in sources[1:]]

    def dealt(part: DataFrame) -> DataFrame:
        return variants(roles(part), sources).withColumns({
            f"_is_{s}": ((F.col("variant") == POOLED_AWARE) & (F.col("source") == s)).cast("double") for s in sources[1:]})

    distinct = cut_lineage(rows.groupBy("fold", "source", "label_delete", *columns).agg(F.count("*").alias("_n")))
    train = dealt(distinct).where("role = 'train' AND trains")
    n, value = F.col("_n"), {c: F.col(c).cast("double") for c in columns}
    rows_with = lambda label: F.sum(F.when(F.col("label_delete") == label, n).otherwise(0))
    means = train.groupBy(*keys).agg((rows_with(0) / rows_with(1)).alias("_w"), *[(F.sum(n * v) / F.sum(F.when(v.isNotNull(), n))).alias(f"_m_{c}") for c, v in value.items()])
    spread = train.join(means, keys).groupBy(*keys, "_w", *[f"_m_{c}" for c in columns]).agg(*[
        F.greatest(F.sqrt(F.sum(n * (v - F.col(f"_m_{c}")) ** 2) / F.sum(F.when(v.isNotNull(), n))), F.lit(1e-8)).alias(f"_d_{c}") for c, v in value.items()])
    stats = cut_lineage(spread)

    def scaled(part: DataFrame) -> DataFrame:
        return part.join(stats, keys).withColumns({f"_x_{c}": (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_d_{c}") for c in columns})

    features = [*[f"_x_{c}" for c in columns], *known]
    weighted = scaled(train).withColumn("_w", n * F.when(F.col("label_delete") == 1, F.col("_w")).otherwise(1.0))
    models = grouped_logistic(weighted, keys, features, "label_delete", "_w", RIDGE)
    test = scaled(dealt(rows).where("role = 'test' AND scored"))
    out = test.join(_table(test, keys, models, "_b"), keys).withColumn("p_delete", stable_sigmoid(_linear(features, "_b")))
    return out.select(*keys, *rows.columns, "p_delete")


def platt_fit(validation: DataFrame, logit: str, label: str, keys: Sequence[str]) -> DataFrame:
    """Columns keys..., a, b of sigmoid(a z + b) with a >= 0 per key; both classes are required.

    The loss is convex: where the free slope is negative, the best allowed one is zero and b the logit of the prevalence.
    """
    models = grouped_logistic(validation, keys, [logit], label)
    bound = {k: v for k, v in models.items() if v[1] < 0}
    if bound:
        flat = validation.groupBy(*keys).agg(F.avg(F.col(label).cast("double")).alias("_p")).collect()
        share = {tuple(r[k] for k in keys): r["_p"] for r in flat}
        models |= {k: np.array([np.log(share[k] / (1 - share[k])), 0.0]) for k in bound}
    return _table(validation, keys, models, "_b").select(*keys, F.col("_b")[1].alias("a"), F.col("_b")[0].alias("b"))
