"""Apply a fitted pipeline to a stream (file source -> model -> file sink)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def score_stream(model, stream: DataFrame) -> DataFrame:
    """Fitted stages are stateless projections: ``transform`` works on a
    streaming DataFrame as on a batch one."""
    return model.transform(stream)


def start_scoring(spark: SparkSession, model, source_dir: str, schema, sink_dir: str, checkpoint_dir: str,
                  columns: list[str] | None = None, fmt: str = "parquet"):
    """Score every new file in ``source_dir`` and append the result to
    ``sink_dir``; the checkpoint folder makes the query restartable with
    exactly-once file output."""
    src = spark.readStream.schema(schema).format(fmt).load(source_dir)
    out = score_stream(model, src)
    if columns:
        out = out.select(*columns)
    return (out.writeStream.format(fmt).option("path", sink_dir)
            .option("checkpointLocation", checkpoint_dir).outputMode("append").start())
