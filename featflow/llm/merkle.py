"""Operator 13: a Merkle manifest of a table by time-forward processing.

A leaf is the digest of a row's fields. Each source has a tree over its rows
in ascending doc_id, ``ARITY`` nodes to a parent, and the sources' roots, in
order, have a tree of their own whose root names the whole table.

Forward sweep. Nodes are labelled (tree, level, index); a node's digest is a
message to the label of its parent, and a node is made when its label comes up
and all messages for it are there. Between tasks Spark's sort shuffle is the
external priority queue: rows are messages, dealt by the part of a tree that
their label lies in and sorted by label. A part is a subtree of ``HEIGHT``
levels (at most 3^8 = 6561 leaves), so a task holds one part, never a tree, and a
source with a third of all rows is many parts. Inside a part a heap holds the
messages. A sweep makes the root of each part; they are the leaves of the next
sweep, until each tree is one node. Rounds grow with log(rows) / HEIGHT.

Reversed sweep. From the root down each node sends its children the proof from
there on: the child's siblings, then the node's own proof. Parts again receive
the message of their root by the sorted shuffle, ahead of their leaves. A leaf
gets its whole proof and folds it with its digest.

Texts are read once and only their digests are shuffled. The one digest of the
whole table is all that reaches the driver.

Edge cases: a null field counts as ``-``, an empty one as ``0:``; null doc_ids
come first in their source, rows that share an id are ordered by their leaf,
equal rows have a leaf each; a null source is a source; a source of one row
has its leaf as subroot, and a table of one source has its subroot as root; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featflow.llm.order import positions
from featflow.llm.store import written
from featflow.operators.joins import broadcast_if_small

ARITY = 3
HEIGHT = 8              # levels of a part
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
OUT_ROWS = 2000


def field(value: Column) -> Column:
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def joined(digests: Sequence[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def levels_of(n: int) -> int:
    """Levels above ``n`` leaves until one node remains."""
    found = 0
    while n > 1:
        n, found = -(-n // ARITY), found + 1
    return found


def forward(leaves: Sequence[str], top: int) -> dict[tuple[int, int], list[str]]:
    """Children's digests of every node of a part of ``top`` levels, by label
    (level, index); messages are taken in the order of their labels."""
    queue = [(1, i // ARITY, i, digest) for i, digest in enumerate(leaves)]       # sorted, so it is a heap
    runs: dict[tuple[int, int], list[str]] = {}
    while queue:
        level, index = queue[0][:2]
        run = []
        while queue and queue[0][:2] == (level, index):
            run.append(heapq.heappop(queue)[3])
        runs[level, index] = run
        if level < top:
            heapq.heappush(queue, (level + 1, index // ARITY, index, joined(run)))
    return runs


def backward(runs: dict[tuple[int, int], list[str]], top: int, proof: tuple) -> list[tuple]:
    """The proof of every leaf: (left, right) siblings a level, from the leaf
    up. Labels are taken in falling order."""
    queue = [(-top, 0, proof)]
    found = []
    while queue:
        level, index, proof = heapq.heappop(queue)
        run = runs[-level, -index]
        for slot, _ in enumerate(run):
            own = (("".join(run[:slot]), "".join(run[slot + 1:])), *proof)
            if level == -1:
                found.append((-index * ARITY + slot, own))
            else:
                heapq.heappush(queue, (level + 1, index * ARITY - slot, own))
    return [own for _, own in sorted(found, key=lambda x: x[0])]


def said(proof: tuple) -> str:
    return ";".join(f"{a},{b}" for a, b in proof)


def heard(proof: str) -> tuple:
    return tuple(tuple(x.split(",")) for x in proof.split(";")) if proof else ()


def folded(digest: str, proof: tuple) -> str:
    for a, b in proof:
        digest = joined((a, digest, b))
    return digest


def _parts(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows sorted by (tree, part, place), one part at a time."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names)):
            if row[:2] != key:
                if rows:
                    yield key, rows
                key, rows = row[:2], []
            rows.append(row[2:])
    if rows:
        yield key, rows


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


_NODE = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("place", pa.int64()), ("digest", pa.string())])
_PROOF = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("proof", pa.string()), ("subroot", pa.string())])
_DONE = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())])


def _top(n: int, height: int) -> int:
    return min(levels_of(n), height)


def _up(batches: Iterator[pa.RecordBatch], height: int) -> Iterator[pa.RecordBatch]:
    out = []
    for (tree, part), rows in _parts(batches, ("tree", "part", "n", "digest")):
        n = rows[0][0]
        top = _top(n, height)
        digest = joined(forward([d for _, d in rows], top)[top, 0])
        out.append((tree, -(-n // ARITY ** height), part, digest))
        if len(out) >= OUT_ROWS:
            yield _batch(out, _NODE)
            out = []
    yield _batch(out, _NODE)


def _down(batches: Iterator[pa.RecordBatch], height: int, last: bool) -> Iterator[pa.RecordBatch]:
    """A part's first row is the message for its root, the others its leaves."""
    names, schema = ("tree", "part", "place", "n", "digest", "proof", "subroot"), _PROOF
    if last:
        names, schema = (*names, "doc_id", "other"), _DONE
    out = []
    for (tree, _), rows in _parts(batches, names):
        message, leaves = rows[0], rows[1:]
        top = _top(leaves[0][1], height)
        proofs = backward(forward([r[2] for r in leaves], top), top, heard(message[3])) if top else [heard(message[3])]
        for r, proof in zip(leaves, proofs):
            if last:
                out.append((r[5], r[2], message[4], joined([x for pair in proof for x in pair]), folded(r[6] or r[2], proof)))
            else:
                out.append((tree, r[0], said(proof), message[4]))
            if len(out) >= OUT_ROWS:
                yield _batch(out, schema)
                out = []
    yield _batch(out, schema)


def _part(place: str, height: int) -> Column:
    return F.expr(f"{place} div {ARITY ** height}").alias("part")


def rise(leaves: DataFrame, height: int) -> tuple[list[DataFrame], DataFrame]:
    """Forward sweeps over ``leaves`` (tree, n leaves of the tree, place from
    0, digest). Returns the tables that the sweeps read, and the trees' roots
    (tree, digest, sweep): a tree of one node is done with that sweep."""
    tables = [leaves]
    while tables[-1].where("n > 1").limit(1).count():
        rows = tables[-1].where("n > 1").select("tree", "n", "place", "digest", _part("place", height))
        dealt = rows.repartition("tree", "part").sortWithinPartitions("tree", "part", "place")
        made = dealt.mapInArrow(partial(_up, height=height), "tree string, n long, place long, digest string")
        tables.append(written(made, "merkle-nodes")[0])
    roots = [t.where("n = 1").select("tree", "digest", F.lit(k).alias("sweep")) for k, t in enumerate(tables)]
    return tables, reduce(DataFrame.unionByName, roots)


def fall(tables: Sequence[DataFrame], roots: DataFrame, height: int, last: bool) -> DataFrame:
    """Reversed sweeps: ``roots`` (tree, sweep, proof, subroot) are the
    messages for the trees' roots. Returns (tree, place, proof, subroot) of
    the first table's rows; with ``last`` their proofs are folded instead."""
    messages = None
    for level in range(len(tables) - 1, -1, -1):
        final = last and level == 0
        here = roots.where(F.col("sweep") == level).select("tree", F.lit(0).cast("long").alias("part"), "proof", "subroot")
        messages = here if messages is None else here.unionByName(messages.select("tree", F.col("place").alias("part"), "proof", "subroot"))
        own = tables[level].select("tree", _part("place", height), "place", "n", "digest", *(["doc_id", "other"] if final else []))
        both = messages.withColumn("place", F.lit(-1).cast("long")).unionByName(own, allowMissingColumns=True)
        dealt = both.repartition("tree", "part").sortWithinPartitions("tree", "part", "place")
        schema = ("doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string" if final
                  else "tree string, place long, proof string, subroot string")
        messages = dealt.mapInArrow(partial(_down, height=height, last=final), schema)
        if level:
            messages = written(messages, "merkle-proofs")[0]
    return messages


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for
    every row. ``proof_sha256`` is the digest of the siblings from the leaf to
    the root. Where 2 divides the CRC-32 of the doc_id, the leaf is made again
    from a text without line feeds before it is folded with its proof;
    ``verified`` says whether the folded root is the root."""
    spark = docs.sparkSession
    fields = {c: F.col(c) for c in FIELDS}
    cut = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    changed = leaf_digest([F.translate("text", "\n", "") if c == "text" else fields[c] for c in FIELDS])
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                         leaf_digest(list(fields.values())).alias("leaf"),
                         F.when(cut & F.contains("text", F.lit("\n")), changed).alias("other"))
    leaves, _ = written(leaves, "merkle-digests")       # dealing by ranges reads its input twice
    placed = positions(leaves, ["source"], ["doc_id", "leaf"], "rank", "merkle-leaves")
    sizes = placed.groupBy(F.col("source").alias("tree")).agg(F.count(F.lit(1)).alias("n"))
    first = (placed.join(broadcast_if_small(sizes), F.col("source").eqNullSafe(F.col("tree")))
                   .select("tree", "n", (F.col("rank") - 1).alias("place"), F.col("leaf").alias("digest"), "doc_id", "other"))
    tables, subroots = rise(first, height)
    named = positions(subroots, [], ["tree"], "rank", "merkle-roots").withColumn("place", F.col("rank") - 1)
    n = named.count()
    if not n:
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
                                         "folded_root string, verified boolean")
    above, top = rise(named.select(F.lit("").alias("tree"), F.lit(n).cast("long").alias("n"), "place", "digest"), height)
    root = top.first()["digest"]
    start = spark.range(1).select(F.lit("").alias("tree"), F.lit(len(above) - 1).alias("sweep"), F.lit("").alias("proof"), F.lit(root).alias("subroot"))
    proofs = fall(above, start, height, last=False).select("place", "proof")
    roots = named.join(proofs, "place").select("tree", "sweep", "proof", F.col("digest").alias("subroot"))
    done = fall(tables, written(roots, "merkle-proofs")[0], height, last=True)
    return done.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root",
                       (F.col("folded_root") == F.lit(root)).alias("verified"))
