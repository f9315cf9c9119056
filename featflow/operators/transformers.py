"""Stateless pipeline stages (X3: a function as a pipeline stage)."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable

from featflow.functions.features import positional_pairs


class PositionalInteractions(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """B21 as a stage: products of columns by position, added in one projection."""
    config = Param(Params._dummy(), "config", "settings (JSON)", TypeConverters.toString)

    def __init__(self, cols: Sequence[str] = (), first: int = 10, second: int = 11):
        super().__init__()
        self._set(config=json.dumps({"cols": list(cols), "first": first, "second": second}))

    def _transform(self, df):
        c = json.loads(self.getOrDefault(self.config))
        pairs = positional_pairs(c["cols"], c["first"], c["second"])
        return df.withColumns(dict(pairs))

    def output_columns(self) -> list[str]:
        c = json.loads(self.getOrDefault(self.config))
        return [n for n, _ in positional_pairs(c["cols"], c["first"], c["second"])]
