"""

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the driver's tables
(or fixtures Spark derives from them); ``oracle`` is an independent SQL text
for DuckDB over the same parquet views, or None where the operator is not
SQL-expressible (model training) and only rows are checked.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

REGISTRY: dict[str, tuple[Callable, str | None]] = {}

MODULES = ["cleaning", "imputation", "encoding", "scaling", "weighting",
           "profiling", "sampling", "modeling", "trees", "ensembles", "evaluation"]


def query(name: str, oracle: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query key {name}")
        REGISTRY[name] = (fn, oracle)
        return fn
    return deco


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"featflow.queries.{m}")


def all_queries() -> dict[str, Callable]:
    _load()
    return {k: v[0] for k, v in REGISTRY.items()}


def all_oracles() -> dict[str, str]:
    _load()
    return {k: v[1] for k, v in REGISTRY.items() if v[1]}
