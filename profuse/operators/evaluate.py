"""Leave-one-out residuals, repeated-score summaries and prediction tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from profuse.functions import scores
from profuse.operators.arrays import vector_to_number
from profuse.operators.gram import moments
from profuse.operators.linear import ridge, ols


def leave_one_out(rows: DataFrame, alpha: float = 0.0) -> DataFrame:
    """Residual of each row under the model fitted without it: e / (1 - h).

    One Gram pass and one scoring pass stand for n refits; the leverage includes
    1/n for the intercept.
    """
    m = moments(rows)["all"]
    a, _, _ = m.centred()
    model = ridge(m, alpha) if alpha else ols(m)
    inverse = np.linalg.pinv(a + alpha * np.eye(m.p), rcond=1e-12, hermitian=True)
    mean, n, coef, bias = m.mean_x, m.n, model.coef, model.intercept

    def leverage(x):
        c = x - mean
        return 1.0 / n + np.einsum("ij,jk,ik->i", c, inverse, c, optimize=True)

    def predict(x):
        return x @ coef + bias

    left_out = (F.col("y") - vector_to_number(predict)) / (F.lit(1.0) - vector_to_number(leverage))
    return rows.withColumn("residual", left_out)


def summarise_scores(rows: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Mean and population variance of repeated scores per setting."""
    return rows.groupBy(*keys).agg(F.avg(score).alias("mean"), F.var_pop(score).alias("variance"))


def mean_prediction(rows: DataFrame, keys=("sample_id",)) -> DataFrame:
    """Average of the fold models' predictions per sample."""
    return rows.groupBy(*keys).agg(F.avg("prediction").alias("prediction"))


def score_table(rows: DataFrame, keys: list[str], y: str = "y", p: str = "prediction") -> DataFrame:
    return rows.groupBy(*keys).agg(
        scores.mse(F.col(y), F.col(p)).alias("mse"), scores.r2(F.col(y), F.col(p)).alias("r2"))
