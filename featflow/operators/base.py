"""Fit-once / apply-lazily stages on top of ``pyspark.ml``.

A ``StatEstimator`` computes its statistics in ONE aggregate job over all of
its columns (never one pass per column) and returns a ``StatModel`` whose
``transform`` is a lazy projection (or a join against a fitted table), so it
is planned and optimized by Catalyst together with the caller's query.

Settings and fitted statistics are JSON params, so every stage works inside
``Pipeline`` / ``CrossValidator`` and saves / loads with the standard
``MLWriter`` / ``MLReader`` (DefaultParamsWritable).
"""

from __future__ import annotations

import json
import math

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame


def _clean(o):
    """JSON-safe copy: NaN -> None."""
    if isinstance(o, float) and math.isnan(o):
        return None
    if isinstance(o, dict):
        return {str(k): _clean(v) for k, v in o.items()}
    if isinstance(o, (list, tuple)):
        return [_clean(v) for v in o]
    return o


class _Configured(Params):
    config = Param(Params._dummy(), "config", "operator settings (JSON)", TypeConverters.toString)

    @property
    def conf(self) -> dict:
        return json.loads(self.getOrDefault(self.config)) if self.isDefined(self.config) else {}


class StatModel(Model, _Configured, DefaultParamsReadable, DefaultParamsWritable):
    stats = Param(Params._dummy(), "stats", "fitted statistics (JSON)", TypeConverters.toString)

    def __init__(self, config: str = "{}", stats: str = "{}"):
        super().__init__()
        self._set(config=config, stats=stats)

    @property
    def fitted(self) -> dict:
        return json.loads(self.getOrDefault(self.stats))

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.apply(df, self.conf, self.fitted)

    def apply(self, df: DataFrame, conf: dict, stats: dict) -> DataFrame:  # pragma: no cover
        raise NotImplementedError


class StatEstimator(Estimator, _Configured, DefaultParamsReadable, DefaultParamsWritable):
    model_class: type[StatModel] = StatModel

    def __init__(self, **config):
        super().__init__()
        self._set(config=json.dumps(_clean(config), sort_keys=True))

    def _fit(self, df: DataFrame) -> StatModel:
        conf = self.conf
        stats = self.compute(df, conf)
        model = self.model_class(config=json.dumps(conf, sort_keys=True),
                                 stats=json.dumps(_clean(stats), sort_keys=True))
        return model

    def compute(self, df: DataFrame, conf: dict) -> dict:  # pragma: no cover
        raise NotImplementedError


def ordered_columns(df: DataFrame, replaced: dict) -> list:
    """Projection list that replaces columns in place and keeps the order."""
    from pyspark.sql import functions as F
    out = []
    for c in df.columns:
        out.append(replaced[c].alias(c) if c in replaced else F.col(f"`{c}`"))
    return out
