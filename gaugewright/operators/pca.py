"""Consolidation of dimension scores by the first principal component.

fit() needs only sums, means and products: one aggregation over the rows, then an eigenvalue problem
as small as the number of columns. transform() is a column expression with literals.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewright.functions.exprs import clip, col, corr, half_even, number


@dataclass(frozen=True)
class Consolidator:
    columns: tuple[str, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]
    pc1: tuple[float, ...]
    mu: float
    sd: float
    explained: float

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @staticmethod
    def from_json(text: str) -> Consolidator:
        return Consolidator(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items()})

    def component(self, names: Sequence[str]) -> Column:
        """PC1 of a row; a column that isn't there, or a NULL, counts as its mean."""
        out = F.lit(0.0)
        for name, mean, std, weight in zip(self.columns, self.means, self.stds, self.pc1, strict=True):
            x = F.coalesce(number(col(name)), F.lit(mean)) if name in names else F.lit(mean)
            out = out + (x - mean) / std * weight
        return out

    def transform(self, df: DataFrame, out: str = "label") -> DataFrame:
        """Label in 0..1, high is good: standardised, cut at 3 deviations, two digits (halves to even)."""
        z = clip((self.component(df.columns) - self.mu) / self.sd, -3.0, 3.0)
        return df.withColumn(out, half_even(1 - (z + 3) / 6, 2))


def fit(df: DataFrame, columns: Sequence[str]) -> Consolidator:
    """z-scores (population), columns without spread dropped, covariance, top eigenvector with a high value meaning bad."""
    x = {c: F.coalesce(number(col(c)), F.lit(float("nan"))) for c in columns}
    complete = df.select(*[F.when(~F.isnan(v), v).alias(c) for c, v in x.items()])
    moments = complete.agg(*[F.avg(col(c)).alias(f"m_{i}") for i, c in enumerate(columns)], *[F.stddev_pop(col(c)).alias(f"s_{i}") for i, c in enumerate(columns)]).first()
    kept = [(c, moments[f"m_{i}"], moments[f"s_{i}"]) for i, c in enumerate(columns) if moments[f"s_{i}"] is not None and moments[f"s_{i}"] > 1e-9]
    if not kept:
        raise ValueError("no column has any spread")
    z = complete.select(*[((F.coalesce(col(c), F.lit(m)) - m) / s).alias(f"z{i}") for i, (c, m, s) in enumerate(kept)])
    n = len(kept)
    pairs = z.agg(*[F.covar_pop(f"z{i}", f"z{j}").alias(f"c{i}_{j}") for i in range(n) for j in range(i, n)]).first()
    cov = np.array([[pairs[f"c{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
    values, vectors = np.linalg.eigh(cov)
    model = Consolidator(tuple(k[0] for k in kept), tuple(k[1] for k in kept), tuple(k[2] for k in kept), tuple(map(float, vectors[:, -1])), 0.0, 1.0, float(values[-1] / values.sum()))
    mean_score = sum((F.coalesce(col(c), F.lit(m)) for c, m, _ in kept), F.lit(0.0)) / n
    got = complete.select(model.component([k[0] for k in kept]).alias("p"), (1 - mean_score).alias("bad")).agg(corr(F.col("p"), F.col("bad")).alias("r"), F.avg("p").alias("mu"), F.stddev_pop("p").alias("sd")).first()
    sign = -1.0 if got.r is not None and got.r < 0 else 1.0
    return replace(model, pc1=tuple(sign * v for v in model.pc1), mu=sign * got.mu, sd=got.sd or 1.0)
