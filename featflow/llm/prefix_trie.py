"""Operator 11: the prefix trie of conversations as a z-fast trie.

Turns. Each turn is a 128-bit digest of (role, text) and a length; texts are
read once and never shuffled. Turns are numbered without a task that holds a
conversation (``order.positions``) and every conversation is rebuilt from its
hundred's first turns and its own rest. A prefix of d turns has a 128-bit key:
two polynomials over Z/2^64 with absolute powers, so a conversation may be cut
into blocks of ``BLOCK`` turns whose keys need only the sums of the blocks
before. A block is one row of at most ``BLOCK`` keys, however long the
conversation is; blocks that end with the same key are one item.

Z-fast trie. The trie holds compacted nodes: an edge of turns from the depth of
the parent to the node's own. A table names each node by the key of its handle,
the prefix whose depth is the two-fattest number of the edge (the one that
the highest power of two divides). An item finds its exit node by fat binary
search: it asks for its own key at the two-fattest depth of the open interval,
goes below a node that it holds whole, above where there is none, and is done in
log2(BLOCK) + 1 questions, each a join on the handle. The edge it leaves on is
found by the key of its first turn.

Batches. Items go in by seeded batches, each ``GROWTH`` times larger than the
last. A batch locates all its items in the trie so far, cuts the edges that
they leave in the middle, and builds a small trie of the items that leave at
the same place by the same turn. The trie so far is a random sample, so such
a group holds about GROWTH * ln(items) of them whatever the data, copies
being one item; a third of all conversations may share their first turns. The
trie is rewritten once a batch, a fifteenth of the work in all.

Counts. Sums over subtrees come from pointer doubling on the compacted nodes:
a node passes what it has to the ancestor 2^k above, log2(height) rounds. Then
edges are expanded: a row for each depth on them.

``ends_sha256`` of a node is one SHA-256 over ids in order, which cannot be
split: ids are sorted by ranges and joined to chunks of ``CHUNK`` ids, and a
node's chunks pass one task as a stream in constant memory.

Edge cases: rows without conv_id are ignored; null roles and texts are empty;
rows of equal turn are ordered by the digest of (role, text), equal rows are
turns of their own; a conversation whose rebuilt turns are none is a member of
the root; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featflow.llm import text as T
from featflow.llm.order import positions
from featflow.llm.store import drop, written
from featflow.operators.joins import broadcast_if_small

BLOCK = 4096
FIRST, GROWTH = 1024, 16
CHUNK = 50_000
HEADS, HUNDRED = 6, 100
BASES = (0xD1342543DE82EF95, 0x9E3779B97F4A7C15)
ROOT = bytes(16)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
NODE = "parent binary, a long, e long, c0 long, keys array<binary>, sums array<long>"


# ---- turns and rebuilt conversations -------------------------------------------------------------

def turns(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return (conversations.where("conv_id is not null")
            .select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.substring(digest, 1, 32)).alias("digest"),
                    F.char_length(text).cast("long").alias("size")))


def rebuilt(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, digest, size, m) of every rebuilt turn, and the plan
    (conv_id, m) of every conversation, m its number of rebuilt turns."""
    heads = (numbered.where(f"conv_id % {HUNDRED} = 0 and pos < {HEADS}").groupBy(F.col("conv_id").alias("base"))
                     .agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "size"))).alias("head")))      # at most HEADS - 1
    convs = numbered.groupBy("conv_id").agg(F.max("pos").alias("n")).select(
        "conv_id", "n", F.expr(f"conv_id - conv_id % {HUNDRED}").alias("base"),
        F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS)).alias("h"))
    plan = (convs.join(heads, "base", "left").withColumn("head", F.coalesce(F.expr("slice(head, 1, cast(h as int))"), F.expr("slice(head, 1, 0)")))
                 .withColumn("k", F.coalesce(F.size("head"), F.lit(0)).cast("long")).withColumn("k", F.greatest("k", F.lit(0).cast("long")))
                 .select("conv_id", "h", "k", "head", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long"))).alias("m")))
    plan, _ = written(plan, "conversation-plans")
    own = (numbered.join(plan.drop("head"), "conv_id").where("pos > h")
                   .select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), "digest", "size", "m"))
    lent = (plan.where("k > 0").select("conv_id", F.explode("head").alias("t"), "m")
                .select("conv_id", F.col("t.pos").alias("depth"), "t.digest", "t.size", "m"))
    return lent.unionByName(own), plan.select("conv_id", "m")


def _block_sums(turns_: pa.ListArray, block: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Offsets, depths, the two running polynomials and running lengths inside each block."""
    offsets = turns_.offsets.to_numpy().astype(np.int64)
    flat = turns_.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    raw = flat.field("digest")
    at = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset:raw.offset + len(raw) + 1]
    pairs = np.frombuffer(raw.buffers()[2], np.uint8)[at[0]:at[-1]].view("<u8").reshape(-1, 2) if len(raw) else np.zeros((0, 2), np.uint64)
    length = np.diff(offsets)
    inside = np.arange(offsets[-1]) - np.repeat(offsets[:-1], length)

    def running(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, x.dtype), np.cumsum(x)])
        return total[1:] - np.repeat(total[offsets[:-1]], length)

    polys = []
    for k, base in enumerate(BASES):
        table, _ = T.powers(base, width)
        start = np.array([pow(base, int(b) * width + 1, 1 << 64) for b in block], np.uint64)
        polys.append(running(pairs[:, k] * table[inside] * np.repeat(start, length)))
    sizes = running(flat.field("size").to_numpy(zero_copy_only=False).astype(np.int64))
    return offsets, inside + np.repeat(block, length) * width + 1, polys, sizes


def _keys(polys: list[np.ndarray], depth: np.ndarray) -> np.ndarray:
    """16 bytes for each prefix; depth 0 is ROOT."""
    mixed = [T.mix64(p ^ (depth.astype(np.uint64) * np.uint64(b))) for p, b in zip(polys, BASES)]
    return np.stack(mixed, axis=1).astype("<u8")


def _binary(keys: np.ndarray) -> pa.Array:
    ends = pa.py_buffer((np.arange(len(keys) + 1) * 16).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, ends, pa.py_buffer(np.ascontiguousarray(keys).tobytes())])


def _totals(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        block = batch.column("block").to_numpy()
        offsets, _, polys, sizes = _block_sums(batch.column("turns"), block, width)
        last = offsets[1:] - 1
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), T.as_long(polys[0][last]), T.as_long(polys[1][last]),
                                          pa.array(sizes[last])], names=["conv_id", "block", "t1", "t2", "tc"])


def _items(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "last", "key", "a", "b", "top", "c0", "keys", "sums"]
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column("block").to_numpy()
        offsets, depth, polys, sizes = _block_sums(batch.column("turns"), block, width)
        length = np.diff(offsets)
        base = [np.array([int(x or 0) % (1 << 64) for x in batch.column(c).to_pylist()], np.uint64) for c in ("b1", "b2")]
        spent = np.array([int(x or 0) for x in batch.column("bc").to_pylist()], np.int64)
        keys = _keys([p + np.repeat(b, length) for p, b in zip(polys, base)], depth)
        a = block * width
        b = a + length
        lists = pa.array(offsets.astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(b == batch.column("m").to_numpy()), _binary(keys[offsets[1:] - 1]), pa.array(a), pa.array(b),
             _binary(_keys(base, a)), pa.array(spent), pa.ListArray.from_arrays(lists, _binary(keys)),
             pa.ListArray.from_arrays(lists, pa.array(sizes + np.repeat(spent, length)))], names=names)


def items_of(turns_: DataFrame, width: int) -> DataFrame:
    """One row for each block of a rebuilt conversation: its depths (a, b],
    the keys and summed lengths on them, the key ``top`` of depth a, and
    whether it is the conversation's last."""
    blocks = (turns_.withColumn("block", F.expr(f"(depth - 1) div {width}")).groupBy("conv_id", "block")
                    .agg(F.max("m").alias("m"), F.sort_array(F.collect_list(F.struct("depth", "digest", "size"))).alias("turns")))
    blocks, _ = written(blocks, "conversation-blocks")
    totals = blocks.where(f"m > {width}").mapInArrow(partial(_totals, width=width), "conv_id long, block long, t1 long, t2 long, tc long")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.sum(F.col(c).cast("decimal(38,0)")).over(before).alias(d) for c, d in (("t1", "b1"), ("t2", "b2"), ("tc", "bc"))]
    placed = blocks.join(broadcast_if_small(totals.select("conv_id", "block", *sums)), ["conv_id", "block"], "left")
    return placed.mapInArrow(partial(_items, width=width),
                             "conv_id long, last boolean, key binary, a long, b long, top binary, c0 long, keys array<binary>, sums array<long>")


# ---- the z-fast trie -----------------------------------------------------------------------------

def two_fattest(a: str, b: str) -> str:
    """SQL for the number in (a, b] that the highest power of two divides."""
    return f"({b} & shiftleft(cast(-1 as bigint), length(bin({a} ^ {b})) - 1))"


def with_names(nodes: DataFrame) -> DataFrame:
    """Nodes with their own key, the key of the first turn of their edge, and
    the key of their handle."""
    return nodes.select("*", F.element_at("keys", -1).alias("key"), F.element_at("keys", 1).alias("first"),
                        F.expr(f"get(keys, cast({two_fattest('a', 'e')} - a - 1 as int))").alias("handle"))


def locate(items: DataFrame, nodes: DataFrame, rounds: int) -> DataFrame:
    """``items`` with ``reach``, the depth of the deepest node whose extent the
    item holds whole, ``edge``, the key of the node on whose edge it leaves
    (null if none does), and ``cut``, the depth where it leaves."""
    nowhere = F.concat(F.lit(b"\0"), F.col("key"))             # a key that no node has, another for each item
    handles = nodes.select("handle", F.col("a").alias("h_a"), F.col("e").alias("h_e"), F.col("key").alias("h_key"))
    state = items.withColumn("lo", F.col("a")).withColumn("hi", F.col("b"))
    for _ in range(rounds):
        asked = state.withColumn("f", F.expr(two_fattest("lo", "hi"))).withColumn(
            "probe", F.when(F.col("lo") < F.col("hi"), F.expr("get(keys, cast(f - a - 1 as int))")).otherwise(nowhere))
        found = asked.join(handles, F.col("probe") == F.col("handle"), "left")
        whole = F.expr("h_e <= b and get(keys, cast(h_e - a - 1 as int)) = h_key")
        hit, live = F.col("h_key").isNotNull(), F.col("lo") < F.col("hi")
        state = found.select(*items.columns,
                             F.when(hit, F.when(whole, F.col("h_e")).otherwise(F.col("h_a"))).otherwise(F.col("lo")).alias("lo"),
                             F.when(hit, F.when(whole, F.col("hi")).otherwise(F.col("h_a"))).when(live, F.col("f") - 1).otherwise(F.col("hi")).alias("hi"))
    edges = nodes.select(F.col("first").alias("x_first"), F.col("key").alias("edge"), F.col("e").alias("x_e"), F.col("keys").alias("x_keys"))
    probe = F.when(F.col("lo") < F.col("b"), F.expr("get(keys, cast(lo - a as int))")).otherwise(nowhere)
    left = state.withColumn("probe", probe).join(edges, F.col("probe") == F.col("x_first"), "left")
    differs = F.expr("array_position(zip_with(slice(keys, cast(lo - a + 1 as int), cast(b - lo as int)), x_keys, (p, q) -> p <=> q), false)")
    cut = F.when(F.col("edge").isNull(), F.col("lo")).otherwise(F.col("lo") + differs - 1)
    return left.select(*items.columns, F.col("lo").alias("reach"), "edge", cut.alias("cut"))


def split_edges(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``nodes`` with an explicit node wherever an item leaves an edge."""
    cuts = found.where("edge is not null").groupBy(F.col("edge").alias("key")).agg(F.collect_set("cut").alias("cuts"))     # at most BLOCK depths
    bounds = F.expr("array_sort(array_distinct(concat(array(a, e), coalesce(cuts, array()))))")
    parts = (nodes.join(cuts, "key", "left").withColumn("bounds", bounds)
                  .withColumn("i", F.explode(F.expr("sequence(1, size(bounds) - 1)")))
                  .withColumn("from", F.expr("get(bounds, i - 1)")).withColumn("to", F.expr("get(bounds, i)")))
    return parts.selectExpr("if(from = a, parent, get(keys, cast(from - a - 1 as int))) as parent", "from as a", "to as e",
                            "if(from = a, c0, get(sums, cast(from - a - 1 as int))) as c0",
                            "slice(keys, cast(from - a + 1 as int), cast(to - from as int)) as keys",
                            "slice(sums, cast(from - a + 1 as int), cast(to - from as int)) as sums")


def subtrie(group: list[tuple], parent: bytes, depth: int, c0: int) -> list[tuple]:
    """Compacted nodes of (keys, sums) sequences below one place: a node at
    every end and wherever two part."""
    made: list[tuple] = []
    group = sorted(group)
    ends = [0]

    def edge(keys: list, sums: list, lo: int, hi: int) -> None:
        made.append((keys[lo - 1] if lo else parent, depth + lo, depth + hi, sums[lo - 1] if lo else c0, keys[lo:hi], sums[lo:hi]))

    for i, (keys, sums) in enumerate(group):
        following = group[i + 1][0] if i + 1 < len(group) else []
        if len(keys) > ends[-1]:
            ends.append(len(keys))
        common, top = 0, min(len(keys), len(following))
        while common < top and keys[common] == following[common]:
            common += 1
        while ends[-1] > common:
            hi = ends.pop()
            if ends[-1] < common:
                ends.append(common)
            edge(keys, sums, ends[-1], hi)
    return made


_NODE = pa.schema([("parent", pa.binary()), ("a", pa.int64()), ("e", pa.int64()), ("c0", pa.int64()),
                   ("keys", pa.list_(pa.binary())), ("sums", pa.list_(pa.int64()))])


def _subtries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by the key of their next turn: a small trie for each."""
    key, held, place, out = None, [], None, []

    def rows() -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [[]] * len(_NODE)
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _NODE)], schema=_NODE)
        out.clear()
        return made

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("next", "parent", "cut", "c0", "keys", "sums")]
        for nxt, parent, cut, c0, keys, sums in zip(*cols):
            if nxt != key:
                if held:
                    out.extend(subtrie(held, *place))
                key, held, place = nxt, [], (parent, cut, c0)
            held.append((keys, sums))
            if len(out) > 2000:
                yield rows()
    if held:
        out.extend(subtrie(held, *place))
    yield rows()


def grow(nodes: DataFrame | None, batch: DataFrame, rounds: int) -> tuple[DataFrame, str]:
    """The trie with a batch of items inserted, written."""
    spark = batch.sparkSession
    if nodes is None:
        found, path = batch.withColumn("reach", F.col("a")).withColumn("edge", F.lit(None).cast("binary")).withColumn("cut", F.col("a")), None
    else:
        found, path = written(locate(batch, nodes, rounds), "trie-places")
    hanging = found.where("cut < b").selectExpr(
        "get(keys, cast(cut - a as int)) as next", "if(cut = a, top, get(keys, cast(cut - a - 1 as int))) as parent", "cut",
        "if(cut = a, c0, get(sums, cast(cut - a - 1 as int))) as c0",
        "slice(keys, cast(cut - a + 1 as int), cast(b - cut as int)) as keys", "slice(sums, cast(cut - a + 1 as int), cast(b - cut as int)) as sums")
    fresh = hanging.repartition("next").sortWithinPartitions("next").mapInArrow(_subtries, NODE)
    grown = fresh if nodes is None else split_edges(nodes, found).unionByName(fresh)
    made = written(with_names(grown), "trie-nodes")
    if path:
        drop(spark, path)
    return made


def build(classes: DataFrame, first: int = FIRST, growth: int = GROWTH) -> DataFrame | None:
    """The compacted nodes of all items, by batches; None without items."""
    spark = classes.sparkSession
    size = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("keys")).alias("most")).first()
    if not size["n"]:
        return None
    share = F.pmod(F.xxhash64("key"), F.lit(1 << 40)) / float(1 << 40)
    done, low, nodes, path = False, 0.0, None, None
    while not done:
        high = min(1.0, first / size["n"])
        done = high >= 1.0
        batch = classes.where((share >= low) & (share < high) if not done else share >= low)
        made, new_path = grow(nodes, batch, int(size["most"]).bit_length())
        if path:
            drop(spark, path)
        nodes, path, low, first = made, new_path, high, first * growth
    return nodes


# ---- counts and rows -----------------------------------------------------------------------------

def subtree_sums(table: DataFrame) -> DataFrame:
    """``table`` (key, parent, n, m, leaves, cc, len, kids) with n, leaves, cc
    and len summed and m least over subtrees, by pointer doubling."""
    spark = table.sparkSession
    now, path = written(table.withColumn("jump", F.col("parent")), "trie-sums")
    keep = ["key", "parent", "kids"]
    while now.where("jump is not null").limit(1).count():
        add = now.where("jump is not null").groupBy(F.col("jump").alias("to")).agg(
            *[F.sum(c).alias(f"+{c}") for c in ("n", "leaves", "cc", "len")], F.min("m").alias("+m"))
        given = now.join(add, F.col("key") == F.col("to"), "left")
        given = given.select(*keep, "jump", *[(F.col(c) + F.coalesce(F.col(f"`+{c}`"), F.lit(0))).alias(c) for c in ("n", "leaves", "cc", "len")],
                             F.least("m", F.col("`+m`")).alias("m"))
        over = now.where("jump is not null").select(F.col("key").alias("from"), F.col("jump").alias("next"))
        probe = F.when(F.col("jump").isNull() | (F.col("jump") == F.lit(ROOT)), F.concat(F.lit(b"\0"), F.col("key"))).otherwise(F.col("jump"))
        then = given.withColumn("probe", probe).join(over, F.col("probe") == F.col("from"), "left")
        then, new_path = written(then.select(*keep, "n", "m", "leaves", "cc", "len", F.col("next").alias("jump")), "trie-sums")
        drop(spark, path)
        now, path = then, new_path
    return now.drop("jump")


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) rows as comma-joined runs of ids."""
    def rows(out: list) -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())],
                                          names=["key", "least", "ids"])

    key, held, out, size = None, [], [], 0
    for batch in batches:
        for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if k != key or len(held) >= chunk:
                if held:
                    out.append((key, held[0], ",".join(map(str, held))))
                    size += len(held)
                key, held = k, []
            held.append(c)
            if size > chunk:
                yield rows(out)
                out, size = [], 0
    if held:
        out.append((key, held[0], ",".join(map(str, held))))
    yield rows(out)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by (key, least) as one digest a key."""
    key, digest, out = None, None, []
    for batch in batches:
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if k != key:
                if key is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.string())], names=["key", "sha"])
        out = []
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["key", "sha"])


def end_digests(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(key, sha): the digest of the ids that end there, ascending."""
    order = [F.col("key"), F.col("conv_id")]
    chunks = (ends.repartitionByRange(*order).sortWithinPartitions(*order)
                  .mapInArrow(partial(_chunks, chunk=chunk), "key binary, least long, ids string"))
    return chunks.repartition("key").sortWithinPartitions("key", "least").mapInArrow(_ends, "key binary, sha string")


def prefix_trie(conversations: DataFrame, first: int = FIRST, growth: int = GROWTH, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256): a row for every node of the trie."""
    said, _ = written(turns(conversations), "conversation-digests")         # dealing by ranges reads its input twice
    numbered = positions(said, ["conv_id"], ["turn", "digest"], "pos", "conversation-turns")
    rows, plan = rebuilt(numbered)
    items, _ = written(items_of(rows, block), "trie-items")
    classes = items.groupBy("key").agg(
        F.sum(F.col("last").cast("long")).alias("copies"), F.min(F.when(F.col("last"), F.col("conv_id"))).alias("least"),
        F.first(F.struct("a", "b", "top", "c0", "keys", "sums")).alias("x")).select("key", "copies", "least", "x.*")
    classes, _ = written(classes, "trie-classes")
    nodes = build(classes, first, growth)

    none = plan.where("m = 0").select("conv_id")
    ends = items.where("last").select("key", "conv_id").unionByName(none.select(F.lit(ROOT).alias("key"), "conv_id"))
    owners = classes.select("key", "copies", "least").unionByName(
        none.groupBy().agg(F.count(F.lit(1)).alias("copies"), F.min("conv_id").alias("least")).select(F.lit(ROOT).alias("key"), "copies", "least"))
    root = plan.sparkSession.range(1).select(
        F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("e"), F.lit(0).cast("long").alias("c0"),
        F.expr("cast(array() as array<binary>)").alias("keys"), F.expr("cast(array() as array<bigint>)").alias("sums"), F.lit(ROOT).alias("key"))
    every = root if nodes is None else nodes.drop("first", "handle").unionByName(root)
    kids = every.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("kids"))
    reach = F.coalesce(F.expr("get(sums, size(sums) - 1)"), F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    table = (every.select("key", "parent", "c0", reach.alias("c")).join(kids, "key", "left").join(owners, "key", "left")
                  .select("key", "parent", F.coalesce("kids", zero).alias("kids"), F.coalesce("copies", zero).alias("n"), F.col("least").alias("m"),
                          F.col("kids").isNull().cast("long").alias("leaves"), (F.coalesce("copies", zero) * F.col("c")).alias("cc"),
                          (F.col("c") - F.col("c0")).alias("len")))
    sums = subtree_sums(table)

    known = sums.select("key", "n", "m", "leaves", "cc", "len", "kids").join(end_digests(ends, chunk), "key", "left")
    above = sums.select(F.col("key").alias("parent"), F.col("m").alias("parent_m"))
    whole = every.drop("e").join(known, "key").join(above, "parent", "left").where("n > 0")
    steps = whole.withColumn("i", F.explode(F.expr("sequence(least(1, size(keys)), size(keys))")))
    spent = F.expr("if(i <= 1, c0, get(sums, i - 2))")
    at_end = F.expr("i = size(keys)")
    return steps.select(
        F.col("m").alias("conv_id"), (F.col("a") + F.col("i")).cast("long").alias("depth"),
        F.when(F.col("i") > 1, F.col("m")).otherwise(F.col("parent_m")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(at_end, F.col("kids")).otherwise(F.lit(1).cast("long")).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("cc") - F.col("n") * spent - (F.col("len") - (spent - F.col("c0")))).alias("saved_tokens"),
        F.when(at_end, F.coalesce("sha", F.lit(EMPTY_SHA))).otherwise(F.lit(EMPTY_SHA)).alias("ends_sha256"))
