"""Operator 3: mix sources to target weights (DataFrame functions only).

One aggregate gives every source its size in words. Sources in code-point
order (null last) take the weights in turn; the sum of all targets is
``share`` of all words, by weight, and no target is above ``most`` times its
source: what is cut off goes to the others by weight until none is above. The
end of that process is found at once: with sources ordered by size / weight,
the ones cut off are a prefix, so running sums give the level of each.

A document is then emitted floor(target / source size) times, plus once more
with a probability equal to the fraction: a Bernoulli draw from the MD5 of the
seed and the id, so reruns, retries and other engines draw alike.

The table of sources has one row for each source and is written once. It is
broadcast only if counted below ``BROADCAST_SOURCES`` rows; beyond that Spark
joins it, and may split a source that holds a large share of the rows.

Edge cases: a null or wordless text has size 0 and is emitted like any other;
sources with no words have target 0 and rate 0, their documents are not
emitted; a null source is a source; rows that share an id (repeats too) draw
alike, and a null id draws as an empty one; extra columns stay as they are in
``mix``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featflow.llm.store import written

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
BROADCAST_SOURCES = 100_000
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def word_count(text: Column) -> Column:
    """Runs of characters other than SPACES: the pieces between runs of
    spaces, less the empty ones a text begins or ends with."""
    pieces = F.size(F.split(text, r"[\x20\x09-\x0D]+", -1)).cast("long")
    edges = [F.substring(text, at, 1).isin(*SPACES).cast("long") for at in (1, -1)]
    return F.when(F.length(text) > 0, pieces - edges[0] - edges[1]).otherwise(F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sizes`` (source, source_size): one row for each source. Adds its
    weight and target. One task sees all sources: a row of some 40 bytes each."""
    first = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(first) - 1, F.lit(len(weights))) + 1
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in weights]), turn.cast("int")))
    order = [F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spent = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most
    left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.lit(float(share)) * F.sum("source_size").over(whole) - spent) / left
    limit = F.col("source_size") * F.lit(float(most))
    w = w.withColumn("level", level)
    # The first source within its limit sets the level for itself and all after it.
    w = w.withColumn("level", F.first(F.when(F.col("level") * F.col("weight") <= limit, F.col("level")), ignorenulls=True).over(whole))
    target = F.least(F.coalesce(F.col("level") * F.col("weight"), limit), limit)
    return w.select("source", "source_size", "weight", target.alias("target"))


def bernoulli(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 32 bits of MD5(seed | key)."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("")))), 1, 8), 16, 10)
    return bits.cast("double") / F.lit(4294967296.0)


def _taken(own: DataFrame, seed: str, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """``own`` (key, source, size, ...) with source_size, target and copies."""
    targets = source_targets(own.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    targets, _ = written(targets.select(F.col("source").alias("t_source"), "source_size", "target"), "targets")
    if targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor("rate") + (bernoulli(F.col("key"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return (own.join(targets, F.col("source").eqNullSafe(F.col("t_source"))).withColumn("rate", rate)
               .withColumn("copies", copies.cast("int")).drop("t_source", "rate"))


def mix_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               seed: str = "mix", weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row."""
    own = docs.select(F.col(id_col).alias("key"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    return _taken(own, seed, weights, share, most).select(
        F.col("key").alias("doc_id"), "source", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        seed: str = "mix", weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: rows of ``docs``, each as many times as it is taken."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = own.select("row", F.col(f"row.`{id_col}`").alias("key"), F.col(f"row.`{source_col}`").alias("source"),
                     word_count(F.col(f"row.`{text_col}`")).alias("size"))
    return (_taken(own, seed, weights, share, most).where("copies > 0")
            .select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*"))
