"""CSV sources and sinks (A1-A3, A6, A9) and model persistence.

Schemas are declared, not inferred, on the production path (inference is a
full extra pass); charsets are passed to the reader. Legacy Java charsets
such as EUC-KR are only accepted by Spark with
``spark.sql.legacy.javaCharsets=true``, which ``read_csv`` sets when needed.
A UTF-8 byte-order mark is stripped by the reader.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "\ufeff"
_STANDARD = {"utf-8", "utf8", "utf-8-sig", "us-ascii", "iso-8859-1", "utf-16", "utf-16le", "utf-16be"}


def read_csv(spark: SparkSession, path: str, schema: str | None = None, encoding: str = "UTF-8",
             header: bool = True) -> DataFrame:
    enc = "UTF-8" if encoding.lower() == "utf-8-sig" else encoding
    if enc.lower() not in _STANDARD:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    r = spark.read.option("header", header).option("encoding", enc).option("multiLine", False)
    if schema:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", True)
    df = r.csv(path)
    # a BOM sticks to the first header name when the reader keeps it
    first = df.columns[0] if df.columns else None
    if first and first.startswith("﻿"):
        df = df.withColumnRenamed(first, first.lstrip("﻿"))
    return df


def _with_head(batches: Iterator[pa.RecordBatch], head: str) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array([head], pa.string())], names=["value"])
    yield from batches


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite",
              encoding: str = "UTF-8") -> None:
    """A directory of CSV part files (no index column). ``utf-8-sig``
    begins every part with a byte-order mark: rows are made to CSV lines, each
    partition gets its head line first, and Spark's text writer writes and
    commits them, so a failed job leaves nothing behind. A legacy Java charset
    such as EUC-KR sets ``spark.sql.legacy.javaCharsets``."""
    if encoding.lower() != "utf-8-sig":
        if encoding.lower() not in _STANDARD:
            df.sparkSession.conf.set("spark.sql.legacy.javaCharsets", "true")
        df.write.mode(mode).option("header", header).option("encoding", encoding).csv(path)
        return
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    spark = df.sparkSession
    names = spark.createDataFrame([tuple(df.columns)], [f"c{i}" for i in range(len(df.columns))])
    head = names.select(F.to_csv(F.struct("*")).alias("v")).first()["v"] if header else None
    lines = df.select(F.to_csv(row).alias("value"))
    if not header:          # the mark stands before the first row of a partition
        lines = lines.mapInArrow(_marked, "value string")
    else:
        lines = lines.mapInArrow(partial(_with_head, head=f"{BOM}{head}"), "value string")
    lines.write.mode(mode).text(path)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = True
    for batch in batches:
        if first and batch.num_rows:
            values = batch.column("value").to_pylist()
            values[0] = BOM + values[0]
            batch, first = pa.RecordBatch.from_arrays([pa.array(values, pa.string())], names=["value"]), False
        yield batch


def template_for(test_path: str) -> str:
    """A3: the submission template sits next to the test file."""
    return test_path.replace("test.csv", "sample_submission.csv")


def fill_template(template: DataFrame, predictions: DataFrame, key: str, column: str = "probability") -> DataFrame:
    """A3: the template's rows (and order column) with the score filled in by key."""
    keep = [c for c in template.columns if c != column]
    return template.select(*keep).join(predictions.select(key, column), key, "left")


def write_feature_list(spark: SparkSession, names: Sequence[str], path: str,
                       column: str = "selected_features") -> None:
    """The selected-feature list as a one-column CSV, order kept."""
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], f"pos int, {column} string")
    write_csv(df.orderBy("pos").select(column).coalesce(1), path)


def select_by_type(df: DataFrame, numeric: bool) -> DataFrame:
    """Columns by data type (string -> categorical, numeric -> numeric)."""
    from pyspark.sql.types import NumericType
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) == numeric]
    return df.select(*[F.col(f"`{c}`") for c in cols])


def dedupe_columns(names: Sequence[str]) -> list[str]:
    """Keep the first occurrence of every column name."""
    seen, out = set(), []
    for n in names:
        if n not in seen:
            seen.add(n)
            out.append(n)
    return out


def save_model(model, path: str) -> None:
    """Any fitted stage or PipelineModel of this library, via MLWriter."""
    model.write().overwrite().save(path)


def save_best(models: dict, scores: dict[object, float], path: str):
    """Of several fitted models only the one of the highest score (the
    first on ties) is saved; returns its name."""
    best = max(models, key=lambda name: scores[name])
    save_model(models[best], path)
    return best


def load_pipeline(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
