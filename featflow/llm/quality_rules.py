"""Operator 4: a ledger of quality rules as bit masks.

One pass over the texts takes the measurements of each document; every rule is
then evaluated once from them and its failure is one bit of ``failed``. The
ledger (id, measurements, failed) is what is stored: a policy is a named mask
over it, so a new version of a policy or an ablation never reads texts again.
A document is kept under a policy when failed & mask is 0.

All rules compare integers, so any engine gives the same bits. Measurements
are numpy over Arrow buffers in slices of a bounded size; nothing is shuffled.

Edge cases: a null text has no words (all counts 0, base rules fail); ids may
be null or repeat, each row has its own row; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featflow.llm import text as T

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_long_words")
SYMBOLS = b"#*$%&|<>"
LONG_WORD = 100

#: Rule name -> SQL condition that is true when a document fails. The position is the bit.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "100 * n_symbols > 30 * n_words",
    "duplicate_lines": "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines",
    "shouting": "n_words >= 50 and n_upper > 4 * n_lower",
    "long_words": "word_chars > 20 * n_words or n_long_words > 0",
    "short_words": "word_chars < 2 * n_words",
}
#: Versioned policies: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_words"),
    "v1": ("too_few_words", "repeated_words", "many_symbols", "duplicate_lines"),
    "v2": tuple(RULES),
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_SPACE = np.zeros(256, bool)
_SPACE[list(T.SPACES)] = True


def _per_range(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(words: T.Words, hashes: np.ndarray) -> np.ndarray:
    """Words of each document inside 3-word windows found twice or more in it."""
    start, end, by_doc = T.gram_ranges(words.first, 3, whole_short=False)
    gone = np.zeros(len(hashes) + 1, np.int64)
    if len(start):
        doc = np.repeat(np.arange(len(words.first) - 1, dtype=np.uint64), np.diff(by_doc))
        h = T.mix64(T.range_hashes(hashes, start, end, T.BASE_WORDS) + doc * np.uint64(T.BASE_BYTES))
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(gone, start[twice], 1)
        np.add.at(gone, end[twice], -1)
    return _per_range(np.cumsum(gone)[:-1] > 0, words.first)


def measures(words: T.Words) -> dict[str, np.ndarray]:
    data, off = words.data, words.offsets
    width = words.ends - words.starts
    first_bytes = (data & 0xC0) != 0x80                  # one for each code point
    lines, duplicate = [], []
    raw = data.tobytes()
    for a, b in zip(off[:-1], off[1:]):
        full = [x for x in raw[a:b].split(b"\n") if x and not x.isspace()]
        lines.append(len(full))
        duplicate.append(len(full) - len(set(full)))
    return {
        "n_words": np.diff(words.first), "word_chars": _per_range(first_bytes & ~_SPACE[data], off),
        "n_symbols": _per_range(_SYMBOL[data], off), "n_dup_lines": np.array(duplicate, np.int64),
        "n_repeat_words": repeated_words(words, words.hashes()), "n_lines": np.array(lines, np.int64),
        "n_upper": _per_range(_UPPER[data], off), "n_lower": _per_range(_LOWER[data], off),
        "n_long_words": _per_range(width > LONG_WORD, words.first),
    }


def _measure_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, words in T.blocks(batch):
            found = measures(words)
            yield pa.RecordBatch.from_arrays([part.column("doc_id")] + [T.as_long(found[m]) for m in MEASURES],
                                             names=["doc_id", *MEASURES])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Mapping[str, str] = RULES) -> DataFrame:
    """(doc_id, measurements, failed): the bit of each failed rule is set."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    measured = own.mapInArrow(_measure_rows, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    failed = F.lit(0).cast("long")
    for bit, condition in enumerate(rules.values()):
        failed = failed.bitwiseOR(F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed", failed)


def mask(names: tuple[str, ...] | list[str], rules: Mapping[str, str] = RULES) -> int:
    return sum(1 << list(rules).index(n) for n in names)


def passes(policy: str = "v2", policies: Mapping[str, tuple[str, ...]] = POLICIES, rules: Mapping[str, str] = RULES) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask(policies[policy], rules))) == 0


def ablation(book: DataFrame, policies: Mapping[str, tuple[str, ...]] = POLICIES, rules: Mapping[str, str] = RULES) -> DataFrame:
    """(policy, version_mask, rule, rejected, rejected_only, kept_without): for
    each policy and rule, the documents the rule rejects, those no other rule
    of the policy rejects, and those kept if the rule were left out. One
    aggregate over distinct bit masks, at most 2^rules rows."""
    counts = book.groupBy("failed").agg(F.count(F.lit(1)).alias("docs"))
    rows = [(p, mask(names, rules), r, 1 << list(rules).index(r)) for p, names in policies.items() for r in names]
    plan = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(m).cast("long").alias("version_mask"), F.lit(r).alias("rule"),
                                        F.lit(b).cast("long").alias("bit")) for p, m, r, b in rows]))
    hit = F.col("failed").bitwiseAND(F.col("version_mask"))
    count = lambda c: F.sum(F.when(c, F.col("docs")).otherwise(0)).alias
    return (counts.select("failed", "docs", plan.alias("p")).select("failed", "docs", "p.*")
            .groupBy("policy", "version_mask", "rule")
            .agg(count(hit.bitwiseAND(F.col("bit")) != 0)("rejected"), count(hit == F.col("bit"))("rejected_only"),
                 count((hit == 0) | (hit == F.col("bit")))("kept_without")))
