"""Regression of labels on feature rows: time-ordered split, imputation, scaling, boosted trees, metrics."""

from __future__ import annotations

import hashlib
import json
import math
import os
import time
from collections.abc import Sequence
from pathlib import Path
from random import Random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewright.functions.exprs import clip, col, number
from gaugewright.operators.ranks import quantiles, row_numbers, unpivoted
from gaugewright.operators.windows import ordinal


def time_split(df: DataFrame, order: Sequence[str], share: float = 0.8, tiebreak: str | None = None, out: str = "part") -> DataFrame:
    """part is train for the first share of rows by time, else test. order: times (or numbers, or times as text) to take the first non-NULL of."""
    kinds = dict(df.dtypes)
    number_of = lambda o: F.unix_micros(F.try_to_timestamp(col(o))) if kinds[o] == "string" else ordinal(df, o)
    at = F.coalesce(*[number_of(o) for o in order if o in kinds])
    cut = int(df.count() * share)
    return row_numbers(df, at, [tiebreak] if tiebreak else [], "_n").withColumn(out, F.when(F.col("_n") <= cut, "train").otherwise("test")).drop("_n")


def usable_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Columns that have values, and more than one."""
    got = df.agg(*[F.min(number(col(n))).alias(f"l{i}") for i, n in enumerate(names)], *[F.max(number(col(n))).alias(f"h{i}") for i, n in enumerate(names)]).first()
    return [n for i, n in enumerate(names) if got[f"l{i}"] is not None and got[f"l{i}"] != got[f"h{i}"]]


def impute_and_scale(df: DataFrame, names: Sequence[str], part: Column | None = None) -> DataFrame:
    """Median for NULL, then z-scores (population), both learned where `part` holds. As columns z_<name>."""
    learn = part if part is not None else F.lit(True)
    medians = quantiles(unpivoted(df, {n: F.when(learn, number(col(n))) for n in names}), [0.5])
    filled = df.withColumns({f"_f{i}": F.coalesce(number(col(n)), F.lit(medians[n][1][0] if n in medians else None).cast("double")) for i, n in enumerate(names)})
    moments = filled.agg(*[f(F.when(learn, F.col(f"_f{i}"))).alias(f"{k}{i}") for i in range(len(names)) for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = filled.crossJoin(F.broadcast(moments))  # a single row
    z = {f"z_{n}": (F.col(f"_f{i}") - F.col(f"m{i}")) / F.when(F.col(f"s{i}") > 0, F.col(f"s{i}")).otherwise(1.0) for i, n in enumerate(names)}
    return out.withColumns(z).select(*[col(c) for c in df.columns], *[col(c) for c in z])


def regression_metrics(truth: Column, guess: Column) -> list[Column]:
    error = guess - truth
    return [F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), (1 - F.try_divide(F.sum(error * error), F.var_pop(F.when(guess.isNotNull(), truth)) * F.count(error))).alias("r2")]


def drawn(trials: int, seed: int) -> list[dict]:
    """Parameters of trials, by the seed. Their ranges."""
    random = Random(seed)
    return [
        {"depth": random.randint(3, 6), "step": random.uniform(0.01, 0.3), "rounds": random.randrange(100, 601, 50), "rows": random.uniform(0.6, 1.0), "columns": random.uniform(0.6, 1.0), "gain": math.exp(random.uniform(math.log(1e-8), 0)) * 1e-3, "seed": seed}
        for _ in range(trials)
    ]


def pipeline(names: Sequence[str], label: str = "label", depth: int = 5, rounds: int = 50, step: float = 0.1, seed: int = 0, rows: float = 1.0, columns: float = 1.0, gain: float = 0.0, stop_column: str | None = None) -> Pipeline:
    """Imputing, scaling and boosted trees. With a column of rows to validate on, boosting stops when they get no better."""
    safe = [f"f{i}" for i in range(len(names))]
    return Pipeline(stages=[Imputer(strategy="median", inputCols=safe, outputCols=[f"i{i}" for i in range(len(names))]), VectorAssembler(inputCols=[f"i{i}" for i in range(len(names))], outputCol="raw"), StandardScaler(withMean=True, inputCol="raw", outputCol="features"), GBTRegressor(labelCol=label, maxDepth=depth, maxIter=rounds, stepSize=step, seed=seed, subsamplingRate=rows, featureSubsetStrategy=str(columns) if columns < 1 else "all", minInfoGain=gain, validationIndicatorCol=stop_column, validationTol=1e-4)])


def renamed(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The model's columns under names without dots; one that isn't there is 0."""
    return df.withColumns({f"f{i}": number(col(n)) if n in df.columns else F.lit(0.0) for i, n in enumerate(names)})


class Predictor:
    """A fitted pipeline with its columns: align, fill, scale, predict, cut to 0..1."""

    def __init__(self, model: PipelineModel, names: Sequence[str], meta: dict | None = None):
        self.model, self.names, self.meta = model, list(names), meta or {}

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        made = self.model.transform(renamed(df, self.names))
        return made.select(*[col(c) for c in df.columns if c != out], clip(F.col("prediction"), 0.0, 1.0).alias(out))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/pipeline")
        from pyspark.sql import SparkSession

        SparkSession.getActiveSession().createDataFrame([(json.dumps({"names": self.names, "meta": self.meta}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    def publish(self, root: str, version: str = "v1", window_seconds: int | None = None, stamp: str | None = None) -> str:
        """Save under <root>/<version>/<time>_<fingerprint>, never over another, and let `latest` (and latest_<seconds>s) point there."""
        print_ = hashlib.md5(json.dumps([self.names, self.meta], default=str, sort_keys=True).encode()).hexdigest()[:10]
        path = Path(root) / version / f"{stamp or time.strftime('%Y%m%d_%H%M%S', time.gmtime())}_{print_}"
        self.save(str(path))
        for name in ("latest", *([f"latest_{window_seconds}s"] if window_seconds else [])):
            link = Path(root) / name
            link.unlink(missing_ok=True)
            link.symlink_to(path.relative_to(root))
        return str(path)

    def info(self) -> dict:
        return {"features": len(self.names), "names": self.names, "metrics": self.meta}

    @staticmethod
    def load(path: str) -> Predictor:
        from pyspark.sql import SparkSession

        saved = json.loads(SparkSession.getActiveSession().read.text(f"{path}/meta").first().value)
        return Predictor(PipelineModel.load(f"{path}/pipeline"), saved["names"], saved["meta"])


def fit(df: DataFrame, names: Sequence[str], label: str = "label", order: Sequence[str] = ("window_end", "window_start"), candidates: Sequence[dict] | None = None, target: float = 0.05, trials: int = 50, seed: int = 42, tiebreak: str | None = None) -> Predictor:
    """Try candidates (`trials` of them drawn by the seed, unless they are given) until one's MAE on the later part is at most the target; the best one wins."""
    candidates = drawn(trials, seed) if candidates is None else candidates
    split = time_split(df, order, tiebreak=tiebreak)
    names = usable_columns(split.where("part = 'train'"), names)
    best = None
    for given in candidates:
        model = pipeline(names, label, stop_column="_later", **given).fit(renamed(split, names).withColumn("_later", F.col("part") == "test"))
        got = Predictor(model, names).predict(split.where("part = 'test'")).agg(*regression_metrics(col(label), F.col("prediction"))).first().asDict()
        if best is None or (got["mae"] or 9) < best.meta["mae"]:
            best = Predictor(model, names, got | {"parameters": given})
        if best.meta["mae"] <= target:
            break
    return best


def model_path(root: str, window_seconds: int | None = None, given: str | None = None) -> str:
    """Where a model is: given, DQ_MODEL_DIR, latest_<seconds>s, latest."""
    if given or os.environ.get("DQ_MODEL_DIR"):
        return given or os.environ["DQ_MODEL_DIR"]
    named = f"{root}/latest_{window_seconds}s"
    return named if window_seconds and os.path.exists(named) else f"{root}/latest"
