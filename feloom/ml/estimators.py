"""Stratified post-processing estimators: one small model per group of rows.

Fitting samples each group (bounded by ``sampleSize``), so a group of any size
costs one task a bounded sample. Models are a DataFrame with one row per group.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.validity import is_finite
from ..operators.projections import valid_score_array
from ..operators.sampling import group_key, stratified_sample
from ..sources.checkpoints import persisted
from . import aligner as aligner_fit
from . import equalizer

#: Models that are sent to all tasks, at most; each is bounded by ``numBins``.
MOST_GROUPS = 10_000


class Stratified(Params):
    inputCol = Param(Params._dummy(), "inputCol", "scores", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "result column", TypeConverters.toString)
    groupCols = Param(Params._dummy(), "groupCols", "columns whose values make a group", TypeConverters.toListString)
    sampleSize = Param(Params._dummy(), "sampleSize", "rows of a group to fit on", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "of the sample", TypeConverters.toInt)

    def _init(self, given: dict, **defaults) -> None:
        self._setDefault(groupCols=[], sampleSize=100_000, seed=0, **defaults)
        self._set(**{k: v for k, v in given.items() if v is not None})

    def get(self, name: str):
        param = self.getParam(name)
        return self.getOrDefault(param) if self.isDefined(param) else None

    def _check(self, schema: T.StructType, outputs: list[str]) -> None:
        names = set(schema.names)
        missing = [c for c in [self.get("inputCol"), *self.get("groupCols")] if c not in names]
        if missing:
            raise ValueError(f"no such columns: {missing}")
        taken = [c for c in outputs if c and c in names]
        if taken or not any(outputs):
            raise ValueError(f"output columns must be named and new: {taken}")

    def _sample(self, df: DataFrame) -> DataFrame:
        sampled = stratified_sample(df, self.get("groupCols"), self.get("sampleSize"), self.get("seed"))
        return sampled.select(group_key(self.get("groupCols")).alias("_group"), F.col(self.get("inputCol")).alias("_x"))


def _collected(models: DataFrame) -> dict[str, dict]:
    rows = models.limit(MOST_GROUPS + 1).collect()
    if len(rows) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    return {r["_group"]: json.loads(r["model"]) for r in rows if r["model"]}


# Equalizer


class ScoreEqualizer(Estimator, Stratified):
    """Scores to their place in the distribution of their group."""

    numBins = Param(Params._dummy(), "numBins", "of the distribution", TypeConverters.toInt)
    noise = Param(Params._dummy(), "noise", "grid of scores", TypeConverters.toFloat)
    eps = Param(Params._dummy(), "eps", "width of the edges", TypeConverters.toFloat)
    randomValue = Param(Params._dummy(), "randomValue", "in place of random noise", TypeConverters.toFloat)
    minInputSize = Param(Params._dummy(), "minInputSize", "values a group needs", TypeConverters.toInt)

    def __init__(self, **given):
        super().__init__()
        self._init(given, numBins=10_000, noise=1e-4, eps=1e-3, minInputSize=1)

    def _fit(self, df: DataFrame) -> "ScoreEqualizerModel":
        self._check(df.schema, [self.get("outputCol")])
        settings = dict(noise=self.get("noise"), eps=self.get("eps"), random_value=self.get("randomValue"), num_bins=self.get("numBins"), min_size=self.get("minInputSize"))

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            message, model = equalizer.fit(pdf["_x"].to_numpy(float), **settings)
            text = None
            if model:
                text = json.dumps({"minval": model.minval, "maxval": model.maxval, "noise": model.noise, "eps": model.eps, "random_value": model.random_value, "intervals": model.intervals.tolist(), "coefficients": model.coefficients.tolist()})
            return pd.DataFrame({"_group": [pdf["_group"].iloc[0]], "message": [message], "model": [text]})

        rows = self._sample(df.where(is_finite(self.get("inputCol"))))
        models = rows.groupBy("_group").applyInPandas(fit, "_group string, message string, model string")
        return ScoreEqualizerModel(_collected(models), self.get("inputCol"), self.get("groupCols"), self.get("outputCol"))


class ScoreEqualizerModel(Model):
    def __init__(self, models: dict[str, dict], input_col: str, group_cols: list[str], output_col: str):
        super().__init__()
        self.models, self.input_col, self.group_cols, self.output_col = models, input_col, group_cols, output_col

    def _transform(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.models)

        @F.pandas_udf("double")
        def score(group: pd.Series, x: pd.Series) -> pd.Series:
            out = pd.Series(np.nan, index=x.index)
            for g, rows in x.groupby(group):
                if g in shared.value:
                    out.loc[rows.index] = equalizer.EqualizerModel(**shared.value[g])(rows.to_numpy(float))
            return out.where(out.notna(), None)

        return df.withColumn(self.output_col, F.nanvl(score(group_key(self.group_cols), F.col(self.input_col).cast("double")), F.lit(None).cast("double")))


# Aligner


class NEPriorClassProba(Estimator, Stratified):
    """Class probabilities whose most probable classes follow prior shares."""

    priorValues = Param(Params._dummy(), "priorValues", "shares of the classes", TypeConverters.toListFloat)

    def __init__(self, **given):
        super().__init__()
        self._init(given)

    def _fit(self, df: DataFrame) -> "NEPriorClassProbaModel":
        self._check(df.schema, [self.get("outputCol")])
        prior = self.get("priorValues")
        if len(prior) < 2 or min(prior) <= 0:
            raise ValueError("two or more positive prior values are needed")

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            message, factors = aligner_fit.fit(np.stack(pdf["_x"].to_numpy()).astype(float), prior)
            return pd.DataFrame({"_group": [pdf["_group"].iloc[0]], "message": [message], "factors": [None if factors is None else factors.tolist()]})

        x = self.get("inputCol")
        rows = self._sample(df.where(valid_score_array(x) & (F.size(x) == len(prior))))
        models = rows.groupBy("_group").applyInPandas(fit, "_group string, message string, factors array<double>")
        kept = persisted(models.where("size(factors) > 0").select("_group", "factors"), "cache")
        return NEPriorClassProbaModel(kept, x, self.get("groupCols"), self.get("outputCol"))


class NEPriorClassProbaModel(Model):
    """Applied as expressions; invalid rows and unknown groups give NULL."""

    def __init__(self, models: DataFrame, input_col: str, group_cols: list[str], output_col: str):
        super().__init__()
        self.models, self.input_col, self.group_cols, self.output_col = models, input_col, group_cols, output_col

    def _transform(self, df: DataFrame) -> DataFrame:
        x = F.col(self.input_col)
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
        joined = df.withColumn("_group", group_key(self.group_cols)).join(self.models, "_group", "left")
        good = valid_score_array(self.input_col) & (F.size(x) == F.size("factors"))
        raw = F.when(good, F.zip_with(x, "factors", lambda p, f: p.cast("double") * f))
        made = joined.withColumn("_raw", raw).withColumn("_sum", total(F.col("_raw")))
        aligned = F.transform("_raw", lambda v: v / F.col("_sum"))
        return made.withColumn(self.output_col, F.when(F.col("_sum") != 0, aligned)).drop("_group", "factors", "_raw", "_sum")


# Quantile thresholds


class ScoreQuantileThreshold(Estimator, Stratified):
    """Classes by quantiles at cumulative prior shares, and a rank within the class; all in SQL."""

    priorValues = Param(Params._dummy(), "priorValues", "shares of the classes", TypeConverters.toListFloat)
    labels = Param(Params._dummy(), "labels", "names of the classes", TypeConverters.toListString)
    rankCol = Param(Params._dummy(), "rankCol", "rank column", TypeConverters.toString)

    def __init__(self, **given):
        super().__init__()
        self._init(given)

    def _fit(self, df: DataFrame) -> "ScoreQuantileThresholdModel":
        self._check(df.schema, [self.get("outputCol"), self.get("rankCol")])
        prior = self.get("priorValues")
        labels = self.get("labels") or [str(i + 1) for i in range(len(prior))]
        if len(prior) < 2 or min(prior) <= 0 or len(labels) != len(prior):
            raise ValueError("two or more positive prior values and as many labels are needed")
        shares = [0.0, *np.minimum(1.0, np.cumsum(prior) / np.sum(prior)).tolist()]
        shares[-1] = 1.0
        rows = self._sample(df.where(is_finite(self.get("inputCol"))))
        models = rows.groupBy("_group").agg(F.percentile(F.col("_x").cast("double"), F.array(*map(F.lit, shares))).alias("q"))
        return ScoreQuantileThresholdModel(models, labels, self.get("inputCol"), self.get("groupCols"), self.get("outputCol"), self.get("rankCol"))


class ScoreQuantileThresholdModel(Model):
    def __init__(self, models: DataFrame, labels: list[str], input_col: str, group_cols: list[str], output_col: str | None, rank_col: str | None):
        super().__init__()
        self.models, self.labels, self.input_col = models, labels, input_col
        self.group_cols, self.output_col, self.rank_col = group_cols, output_col, rank_col

    def _transform(self, df: DataFrame) -> DataFrame:
        n = len(self.labels)
        joined = df.withColumn("_group", group_key(self.group_cols)).join(self.models, "_group", "left")
        x = F.col(self.input_col).cast("double")
        # quantiles 1..n-1 are the thresholds between classes
        at = F.size(F.filter(F.slice("q", 2, n - 1), lambda t: t <= x)) + 1
        known = x.isNotNull() & ~F.isnan(x) & F.col("q").isNotNull()
        made = joined.withColumn("_class", F.when(known, at))
        c = F.col("_class")
        left, right = F.get("q", c - 1), F.get("q", c)
        middle = F.when(c == 1, left).when(c == n, right).otherwise((left + right) / 2)
        below = F.when(c == 1, F.lit(1.0)).otherwise(F.try_divide(x - left, middle - left))
        above = F.when(c == n, F.lit(1.0)).otherwise(F.try_divide(right - x, right - middle))
        out = {}
        if self.output_col:
            out[self.output_col] = F.get(F.array(*map(F.lit, self.labels)), c - 1)
        if self.rank_col:
            out[self.rank_col] = F.when(c.isNotNull(), F.when(x <= middle, below).otherwise(above))
        return made.withColumns(out).drop("_group", "q", "_class")
