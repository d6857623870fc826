"""Batch application of many models to feature rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.domains import dense_vector, group_indices, merge_groups
from .models import ModelBase, make_model

SCORED = [
    T.StructField("score", T.DoubleType()),
    T.StructField("scores_raw", T.ArrayType(T.DoubleType())),
    T.StructField("scores_trf", T.ArrayType(T.DoubleType())),
    T.StructField("audience_name", T.StringType()),
    T.StructField("category", T.StringType()),
]


def parse_models(packed: str) -> dict[str, str]:
    """``name->path;name->path`` to a dict."""
    pairs = (p.split("->", 1) for p in packed.split(";") if p.strip())
    return {a.strip(): b.strip() for a, b in pairs}


def apply_models(df: DataFrame, models: list[ModelBase | dict | str], keep: list[str], group_column: str | None = None) -> DataFrame:
    """One row per row and usable model: ``keep`` columns and score columns.

    The feature vector of a row is made once, in the JVM, over the union of all
    models' features, and only it and the kept columns reach the Python workers,
    which score whole Arrow batches per model.
    """
    ready = [m for m in (m if isinstance(m, ModelBase) else make_model(m) for m in models) if m.ok]
    merged = merge_groups([m.groups for m in ready])
    indices = [group_indices(m.groups, merged) for m in ready]
    vector = dense_vector(merged, df.schema) if merged else F.array().cast("array<double>")
    group = F.coalesce(F.col(group_column).cast("string"), F.lit("")) if group_column else F.lit("")
    packed = df.select(*keep, vector.alias("_x"), group.alias("_g"))
    schema = T.StructType([packed.schema[c] for c in keep] + SCORED)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack([np.asarray(v, float) for v in pdf["_x"]]) if merged else np.zeros((len(pdf), 0))
            for model, at in zip(ready, indices):
                for g, rows in pdf.groupby("_g").indices.items():
                    done = model.apply(x[rows][:, at], g)
                    out = pdf.iloc[rows][keep].reset_index(drop=True)
                    for f in SCORED:
                        value = done[f.name]
                        out[f.name] = list(value) if isinstance(value, np.ndarray) and value.ndim == 2 else value
                    yield out

    return packed.mapInPandas(run, schema)
