"""The whole preprocessing chain as one ``pyspark.ml.Pipeline``.

categorical: fill 'Unknown' -> sorted ordinal codes (unseen -1)
numeric:     fill train mean -> min-max -> (1 %, 99 %) +- 1.5 range fence
             -> Yeo-Johnson (standardised) -> positional products.

``Pipeline.fit`` fits each stage on the training rows as transformed by the
stages before it, so no statistic sees held-out rows. The training table is
persisted once for the ~8 small fit jobs and released afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame

from featflow.operators.encode import Ordinal
from featflow.operators.impute import Impute
from featflow.operators.scale import Fence, MinMax, YeoJohnson
from featflow.operators.transformers import PositionalInteractions


def chain(categorical: Sequence[str], numeric: Sequence[str]) -> Pipeline:
    return Pipeline(stages=[
        Impute(categorical, strategy="label", value="Unknown"),
        Impute(numeric, strategy="mean"),
        Ordinal(categorical, unknown=-1),
        MinMax(numeric),
        Fence(numeric, lower=0.01, upper=0.99, k=1.5),
        YeoJohnson(numeric),
        PositionalInteractions(numeric),
    ])


def fit_chain(train: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> PipelineModel:
    cached = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return chain(categorical, numeric).fit(cached)
    finally:
        cached.unpersist()
