"""A stacked model as an estimator, and a search over its base and meta
parameters together (J8, J10).

``FoldStore`` keeps fitted base models by (base, parameters, left-out folds)
and their out-of-fold scores by (base, parameters, left-out fold). A draw of a
search refits only the bases whose parameters are new; draws that differ in
the meta model alone fit no base at all. A model that leaves out the folds i
and j scores i for the outer fold j and j for the outer fold i, so k folds need
k (k + 1) / 2 fits of a base, not k * k.
"""

from __future__ import annotations

import json
import random
import threading
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import Future
from functools import reduce

from pyspark.ml import Estimator, Model
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featflow.operators import models as M
from featflow.operators.sample import class_weights
from featflow.operators.scale import Robust
from featflow.plans.training import search_table
from featflow.session import ensure_checkpoint_dir


class FoldStore:
    """Base models and out-of-fold scores over ``data`` (key, label, fold
    column, ``features``; best cached). ``makers`` maps a base to a function of
    its parameters that returns an estimator."""

    def __init__(self, data: DataFrame, key: str, fold: str, label: str, makers: Mapping[str, Callable[..., Estimator]]):
        self.data, self.key, self.fold, self.label, self.makers = data, key, fold, label, dict(makers)
        self.folds = sorted(r[0] for r in data.select(fold).distinct().collect())      # one row a fold
        if len(self.folds) < 3:
            raise ValueError("a store of nested folds needs three folds")
        ensure_checkpoint_dir(data.sparkSession)
        self.fits = 0
        self._kept: dict[tuple, Future] = {}
        self._lock = threading.Lock()

    def _once(self, name: tuple, make: Callable):
        """Made by the first caller; others wait for it."""
        with self._lock:
            held, mine = self._kept.get(name), False
            if held is None:
                held, mine = self._kept.setdefault(name, Future()), True
        if mine:
            try:
                held.set_result(make())
            except BaseException as e:
                with self._lock:
                    del self._kept[name]
                held.set_exception(e)
        return held.result()

    def model(self, base: str, params: Mapping, without: Sequence = ()):
        """The base fitted on the rows of all folds but ``without``."""
        without = tuple(sorted(set(without)))

        def fit():
            with self._lock:
                self.fits += 1
            rows = self.data.where(~F.col(self.fold).isin(list(without))) if without else self.data
            return self.makers[base](**params).fit(rows)

        return self._once(("model", base, json.dumps(params, sort_keys=True), without), fit)

    def scores(self, base: str, params: Mapping, outer=None) -> DataFrame:
        """(key, base) out-of-fold scores of all rows but those of ``outer``, written."""
        def made():
            parts = []
            for k in self.folds:
                if k != outer:
                    model = self.model(base, params, [k] if outer is None else [k, outer])
                    part = M.positive_probability(model.transform(self.data.where(F.col(self.fold) == k)))
                    parts.append(part.select(self.key, F.col("probability_1").alias(base)))
            return reduce(DataFrame.unionByName, parts).checkpoint()

        return self._once(("scores", base, json.dumps(params, sort_keys=True), outer), made)

    def matrix(self, bases: Mapping[str, Mapping], outer=None, balanced: bool = False) -> tuple:
        """What the meta models of some bases are fitted on: the scaler, the
        scaled scores (written), their number, and the name of the weights."""
        def made():
            names, weight = list(bases), None
            rows = self.data.select(self.key, self.label)
            for name in names:
                rows = rows.join(self.scores(name, bases[name], outer), self.key)
            rows = rows.checkpoint()
            scaler = Robust(names).fit(rows)
            train = M.assemble(scaler.transform(rows), names)
            if balanced:
                weight = "_class_weight"
                train = class_weights(train, self.label, "balanced", name=weight)
            return scaler, train, rows.count(), weight

        return self._once(("matrix", json.dumps(list(bases.items()), sort_keys=True), outer, balanced), made)


class StackModel(Model):
    """Base models, a robust scaler and a meta model; adds ``probability``
    (vector) and keeps the bases' scores as columns of their names."""

    def __init__(self, bases: dict, scaler, meta):
        super().__init__()
        self.bases, self.scaler, self.meta = bases, scaler, meta

    def _transform(self, df: DataFrame) -> DataFrame:
        names = list(self.bases)
        own = [c for c in df.columns if c not in names]
        scored = df
        for name, model in self.bases.items():
            kept = [*own, *[n for n in names if n in scored.columns and n != name]]
            out = M.positive_probability(model.transform(scored.select(*kept)), name="_p")
            scored = out.select(*kept, F.col("_p").alias(name))
        scaled = self.scaler.transform(scored.withColumn("_base", F.col("features")).drop("features"))
        done = self.meta.transform(M.assemble(scaled, names))
        return done.drop("features", "rawPrediction", "prediction").withColumnRenamed("_base", "features")

    def save(self, path: str) -> None:
        """Every part under ``path`` with its own writer, and the bases' names in order."""
        for name, model in self.bases.items():
            model.write().overwrite().save(f"{path}/base-{name}")
        self.scaler.write().overwrite().save(f"{path}/scaler")
        self.meta.write().overwrite().save(f"{path}/meta")
        spark = SparkSession.active()
        spark.createDataFrame(list(enumerate(self.bases)), "place int, name string").coalesce(1).write.mode("overwrite").parquet(f"{path}/bases")

    @classmethod
    def load(cls, path: str) -> StackModel:
        spark = SparkSession.active()
        names = [r["name"] for r in spark.read.parquet(f"{path}/bases").orderBy("place").collect()]        # one row a base
        part = lambda name: DefaultParamsReader.loadParamsInstance(f"{path}/{name}", spark)
        return cls({n: part(f"base-{n}") for n in names}, part("scaler"), part("meta"))


class Stack(Estimator):
    """An estimator over a ``FoldStore``: ``bases`` maps each base to its
    parameters, ``meta`` makes the meta estimator from ``meta_params`` and the
    number of its rows (a logistic regression of inverse penalty C unless
    given), ``balanced`` weighs classes by n / (classes * n_class). Fitted on
    the store's rows, or on all of them but one fold; the fold that is missing
    is the outer one."""

    def __init__(self, store: FoldStore, bases: Mapping[str, Mapping], meta_params: Mapping | None = None,
                 meta: Callable[..., Estimator] | None = None, balanced: bool = False):
        super().__init__()
        self.store, self.bases, self.balanced = store, {k: dict(v) for k, v in bases.items()}, balanced
        self.meta_params = dict(meta_params or {})
        self.meta = meta or (lambda n_rows, weight_col=None, C=1.0: M.logistic(C=C, n_rows=n_rows, weight_col=weight_col))

    def _fit(self, df: DataFrame) -> StackModel:
        store = self.store
        have = {r[0] for r in df.select(store.fold).distinct().collect()}
        missing = [k for k in store.folds if k not in have]
        if len(missing) > 1 or have - set(store.folds):
            raise ValueError("fit on the store's rows, or on all of them but one fold")
        outer = missing[0] if missing else None
        scaler, train, n_rows, weight = store.matrix(self.bases, outer, self.balanced)
        options = {"weight_col": weight} if weight else {}
        meta = self.meta(n_rows=n_rows, **options, **self.meta_params).fit(train)
        without = [outer] if outer is not None else []
        return StackModel({n: store.model(n, self.bases[n], without) for n in self.bases}, scaler, meta)


def draws(space: Mapping[str, Sequence], n_iter: int, seed: int = 42) -> list[dict]:
    """``n_iter`` distinct seeded draws of "base__parameter" and
    "meta__parameter" values, all of them if there are fewer."""
    names = sorted(space)
    total = reduce(lambda a, n: a * len(space[n]), names, 1)
    found = []
    for number in random.Random(seed).sample(range(total), min(n_iter, total)):
        draw = {}
        for name in names:
            number, at = divmod(number, len(space[name]))
            draw[name] = space[name][at]
        found.append(draw)
    return found


def split_draw(draw: Mapping, bases: Sequence[str]) -> tuple[dict, dict]:
    """Parameters by base, and those of the meta model."""
    own: dict[str, dict] = {b: {} for b in bases}
    meta = {}
    for name, value in draw.items():
        base, _, param = name.partition("__")
        (meta if base == "meta" else own[base])[param] = value
    return own, meta


def joint_search(store: FoldStore, space: Mapping[str, Sequence], n_iter: int, seed: int = 42, refit: bool = True, parallelism: int = 4,
                 **options) -> tuple[DataFrame, dict, StackModel | None]:
    """A search over base and meta parameters together by the AUC of the outer
    folds. Returns ``search_table``'s result, the best draw, and with ``refit``
    the best stack fitted on all rows. ``options`` go to ``Stack``."""
    chosen = {json.dumps(d, sort_keys=True): d for d in draws(space, n_iter, seed)}

    def maker(draw: dict) -> Callable[[], Stack]:
        own, meta = split_draw(draw, list(store.makers))
        return lambda: Stack(store, own, meta, **options)

    table = search_table(store.data, {name: maker(d) for name, d in chosen.items()}, store.fold, store.label, parallelism=parallelism)
    best = chosen[table.orderBy("rank").first()["candidate"]]
    return table, best, maker(best)().fit(store.data) if refit else None
