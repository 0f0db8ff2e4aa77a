"""Trie of conversation prefixes, with totals of subtrees by centroid decomposition.

A node is a distinct sequence of first d turns; its members are the
conversations that start with it.  ``number_turns`` gives the turns their
places, ``prefix_paths`` names every prefix by a hash chain over its turns,
``trie_nodes`` aggregates the members, ``subtree_totals`` rolls values up.

Rollup, by centroid decomposition of the parent-edge forest.  A component is a
connected piece with a top.  The nodes with at least half of its nodes below
them form the path from the top to the centroid, the last of them.  The
centroid is taken out: the subtrees of its children become components, the rest
above stays one with less than half of the nodes.  The values below the centroid are
summed by component; with the centroid's own they are its total, which is added
to every node on the centroid-to-top path, whose sizes shrink by the centroid's.
A node's total is the one of its own round plus what was added before.  Every
component halves, so a chain of any depth and a hub with any number of children
both take a logarithmic number of rounds.  Rounds run as joins and aggregates
while a component has more than ``local_nodes`` nodes; the smaller ones are
finished many to a task by the same rounds in numpy.

Which component a node falls into needs no walk: a node belongs to its least
member (the owner), whose path is known, so the child of the centroid above a
node is the node of the owner's path one below the centroid - an equi-join.
Component sizes need no walk either: the nodes below v are those its members own.

Scale: a conversation with a third of all turns is numbered over several range
partitions and hashed in chunks of ``chunk`` turns; members meet in partial
aggregates only; the ids that end at a node are joined to blocks of 65536
possible ids before the hash is run over the blocks in order, as a stream (one
SHA-256 is sequential; the blocks of one node pass through one task).

Defined cases: turns without a conversation id belong to none; null role or text
is empty; turns of equal number are ordered by role and text's hash; repeated
rows are turns of their own; an empty table has no nodes; other columns are not
read.  Ids must be integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import materialize
from spendlens.operators.attach import attach

CHUNK = 4096
LOCAL_NODES = 100_000
ID_BLOCK_BITS = 16
ROOT = hashlib.sha256(b"").digest()


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).to_pylist()


def turn_digest(role: Column, text: Column) -> Column:
    """A hash of (role, text); the length keeps the two apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def number_turns(turns: DataFrame) -> DataFrame:
    """``(conv_id, pos, digest, size)``: place from 0 in the conversation, hash, code points of the text."""
    bare = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_digest(F.col("role"), F.col("text")).alias("digest"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), F.monotonically_increasing_id().alias("nth"))
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("digest"), F.asc("nth")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, n = None, 0
        for batch in batches:
            conv = batch.column("conv_id").to_numpy(zero_copy_only=False)
            if not len(conv):
                continue
            new = np.concatenate([[conv[0] != before], conv[1:] != conv[:-1]])
            at = np.arange(len(conv))
            start = np.maximum.accumulate(np.where(new, at, -1))
            local = np.where(start < 0, n + at, at - start)
            before, n = conv[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(local, pa.int64()), batch.column("digest"), batch.column("size")],
                                             ["conv_id", "local", "digest", "size"])

    sorted_rows = bare.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "size")
    local = sorted_rows.mapInArrow(number, "conv_id long, local long, digest binary, size long").withColumn("part", F.spark_partition_id())
    local = materialize(local, "trie-turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = local.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("offset", F.sum("n").over(before))
    later = parts.where("offset > 0").select("conv_id", "part", "offset")  # conversations cut by a partition's end
    placed = attach(local, later, ["conv_id", "part"], spread="local", how="left")
    return placed.select("conv_id", (F.col("local") + F.coalesce("offset", F.lit(0))).alias("pos"), "digest", "size")


def whole_conversations(numbered: DataFrame) -> DataFrame:
    """``(conv_id, pos, digest, size, length)`` of the turns as they are."""
    return attach(numbered, numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length")), ["conv_id"], spread="pos")


def rebuilt_conversations(numbered: DataFrame, block: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of the first of their block: turns, and ``(conv_id, length)``.

    h = crc32 of the decimal id mod (``longest`` + 1): the first h turns of
    conversation c - c % ``block`` (all if fewer, none if absent), then c's own
    from the h-th on.
    """
    n_own = numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    h = F.pmod(F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")), F.lit(longest + 1))
    convs = n_own.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % block})
    of_base = n_own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    plan = convs.join(of_base, "base", "left").withColumn("shared", F.least("h", F.coalesce("n_base", F.lit(0))))
    plan = plan.withColumn("length", F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    plan = materialize(plan.select("conv_id", "base", "h", "shared", "length"), "trie-plan")
    wanted = plan.where("shared > 0").select("conv_id", "base", "length", F.explode(F.sequence(F.lit(0), F.col("shared") - 1)).alias("pos"))
    first = numbered.where(F.col("pos") < longest).withColumnRenamed("conv_id", "base")
    head = wanted.join(first, ["base", "pos"]).select("conv_id", "pos", "digest", "size", "length")
    own = attach(numbered, plan.drop("base"), ["conv_id"], spread="pos").where("pos >= h")
    own = own.select("conv_id", (F.col("shared") + F.col("pos") - F.col("h")).alias("pos"), "digest", "size", "length")
    return head.unionByName(own), plan.select("conv_id", "length")


def prefix_paths(turns: DataFrame, convs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(conv_id, depth, node, parent, size, length)``: the path of every conversation, the root (depth 0) included."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, state = None, None
        for batch in batches:
            local, last = [], []
            for conv, part, digest in zip(_column(batch, "conv_id"), _column(batch, "part"), _column(batch, "digest"), strict=True):
                if (conv, part) != place:
                    place, state = (conv, part), hashlib.sha256()
                last.append(state.digest())
                state.update(digest)
                local.append(state.digest())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "part", "pos", "size", "length")),
                                              pa.array(local, pa.binary()), pa.array(last, pa.binary())],
                                             ["conv_id", "part", "pos", "size", "length", "local", "last"])

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, value = None, b""
        for batch in batches:
            out = []
            for conv, local in zip(_column(batch, "conv_id"), _column(batch, "local"), strict=True):
                value = hashlib.sha256(value + local).digest() if conv == place else local
                place = conv
                out.append(value)
            nexts = pa.array([p + 1 for p in _column(batch, "part")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), nexts, pa.array(out, pa.binary())], ["conv_id", "part", "carry"])

    placed = turns.withColumn("part", F.floor(F.col("pos") / chunk).cast("long"))
    ordered = placed.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "pos").select("conv_id", "part", "pos", "size", "length", "digest")
    local = materialize(ordered.mapInArrow(chain, "conv_id long, part long, pos long, size long, length long, local binary, last binary"), "trie-chains")
    full = local.where(F.col("pos") % chunk == chunk - 1).select("conv_id", "part", "local")
    carried = full.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(carry, "conv_id long, part long, carry binary")
    both = local.join(carried, ["conv_id", "part"], "left")
    after = lambda c: F.when(F.col("carry").isNull(), F.col(c)).otherwise(F.unhex(F.sha2(F.concat("carry", c), 256)))
    parent = F.when(F.col("pos") % chunk == 0, F.coalesce("carry", F.lit(ROOT))).otherwise(after("last"))
    below = both.select("conv_id", (F.col("pos") + 1).alias("depth"), after("local").alias("node"), parent.alias("parent"), "size", "length")
    zero = F.lit(0).cast("long")
    top = convs.select("conv_id", zero.alias("depth"), F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), zero.alias("size"), "length")
    return materialize(below.unionByName(top), "trie-paths")


def trie_nodes(paths: DataFrame) -> DataFrame:
    """``(node, depth, parent, size, conv_id, n_convs, n_below)``: least member, members, nodes of the subtree."""
    members = paths.groupBy("node", "depth", "parent", "size").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    members = materialize(members, "trie-members")
    owned = members.groupBy("conv_id").agg(F.count(F.lit(1)).alias("owned"))
    lengths = paths.where("depth = 0").select("conv_id", "length").join(owned, "conv_id", "left").na.fill(0, ["owned"])
    with_owned = attach(paths.select("conv_id", "node", "depth"), lengths.select("conv_id", "owned"), ["conv_id"], spread="depth")
    reach = with_owned.groupBy("node").agg(F.sum("owned").alias("reach"))
    nodes = members.join(reach, "node")
    nodes = attach(nodes, lengths, ["conv_id"], spread="depth")
    return nodes.withColumn("n_below", F.col("reach") - F.col("owned") + F.col("length") - F.col("depth") + 1).drop("reach", "owned", "length")


def centroid_totals(parent: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree totals of a forest by the rounds of the module; ``parent[i] < i``, or -1 for a top."""
    n = len(parent)
    size = np.ones(n, dtype=np.int64)
    for i in range(n - 1, -1, -1):
        if parent[i] >= 0:
            size[parent[i]] += size[i]
    at, up = np.arange(n), parent.copy()
    out, live = values.astype(np.int64).copy(), np.ones(n, dtype=bool)
    while live.any():
        top = np.where(up < 0, at, up)  # pointers jump until every node knows its component's top
        while not np.array_equal(top, top[top]):
            top = top[top]
        path = np.flatnonzero(live & (2 * size >= size[top]))
        centroid = np.full(n, -1)
        centroid[top[path]] = path  # the deepest has the largest number, and the last assignment stays
        mine = centroid[top]
        child = live & (up >= 0) & (up == mine)
        cut = np.where(child | (at == mine), -1, up)
        part = np.where(cut < 0, at, cut)
        while not np.array_equal(part, part[part]):
            part = part[part]
        below = live & (child[part])
        gain = np.zeros_like(out)
        np.add.at(gain, mine[below], values[below])  # component totals
        c = np.unique(mine[live])
        out[c] += gain[c]
        gain[c] += values[c]
        above = path[path != mine[path]]
        out[above] += gain[mine[above]]
        size[above] -= size[mine[above]]
        live[c] = False
        up = np.where(live, cut, -1)
    return out


def subtree_totals(nodes: DataFrame, paths: DataFrame, values: list[str], local_nodes: int = LOCAL_NODES) -> DataFrame:
    """``(node, *values)``: each value summed over the node's subtree.

    ``nodes`` as from ``trie_nodes`` with the value columns (long), ``paths`` the
    paths of the owners.
    """
    n = nodes.count()
    added = {v: f"_add_{v}" for v in values}
    zero = F.lit(0).cast("long")
    state = nodes.select("node", "parent", "depth", F.col("conv_id").alias("owner"), F.col("n_below").alias("below"), *values,
                         F.lit(ROOT).alias("comp"), F.lit(n).cast("long").alias("total"), *[zero.alias(a) for a in added.values()])
    finished, small = [], []
    while True:
        state = materialize(state, "trie-components")
        small.append(state.where(F.col("total") <= local_nodes))
        big = state.where(F.col("total") > local_nodes)
        if big.isEmpty():
            break
        state, done = _split_round(big, paths, values, added)
        finished.append(done)
    rest = small[0]
    for s in small[1:]:
        rest = rest.unionByName(s)
    out = _finish(rest, values, added, max(1, -(-n // local_nodes)))
    for done in finished:
        out = out.unionByName(done)
    return out


def _split_round(big: DataFrame, paths: DataFrame, values: list[str], added: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Take the centroid out of every component: the nodes left with their new components, and the centroids' totals."""
    half = big.where(F.col("below") * 2 >= F.col("total"))
    centroids = half.groupBy("comp").agg(F.min(F.struct("below", "depth", "node")).alias("c")).select(
        "comp", F.col("c.node").alias("c"), F.col("c.depth").alias("c_depth"), F.col("c.below").alias("c_below"))
    centroids = materialize(centroids, "trie-centroids")  # at most one for local_nodes nodes
    through = paths.join(centroids.select(F.col("c").alias("parent"), "comp"), "parent").select(
        F.col("conv_id").alias("owner"), "comp", F.col("node").alias("child"))
    placed = attach(big, centroids, ["comp"], spread="node")
    placed = attach(placed, through, ["owner", "comp"], spread="depth", how="left")
    under = (F.col("depth") > F.col("c_depth")) & F.col("child").isNotNull()
    placed = materialize(placed.withColumn("child", F.when(under, F.col("child"))), "trie-placed")
    is_c = F.col("node") == F.col("c")
    counted = F.col("child").isNotNull() | is_c
    gains = placed.groupBy("comp").agg(*[F.sum(F.when(counted, F.col(v))).alias(f"_gain_{v}") for v in values])
    placed = attach(placed, gains, ["comp"], spread="node")
    done = placed.where(is_c).select("node", *[(F.col(f"_gain_{v}") + F.col(a)).alias(v) for v, a in added.items()])
    on_path = F.col("child").isNull() & (F.col("below") * 2 >= F.col("total"))
    rest = placed.where(~is_c).withColumns({
        **{a: F.col(a) + F.when(on_path, F.col(f"_gain_{v}")).otherwise(0) for v, a in added.items()},
        "_below": F.col("below") - F.when(on_path, F.col("c_below")).otherwise(0),
        "_comp": F.coalesce("child", "comp"),
    })
    rest = rest.select("node", "parent", "depth", "owner", F.col("_below").alias("below"), *values, F.col("_comp").alias("comp"), *added.values())
    totals = rest.groupBy("comp").agg(F.count(F.lit(1)).alias("total"))
    return attach(rest, totals, ["comp"], spread="node"), done


def _finish(state: DataFrame, values: list[str], added: dict[str, str], buckets: int) -> DataFrame:
    """Components of at most ``local_nodes`` nodes, many to a task."""

    def totals(table: pa.Table) -> pa.Table:
        frame = table.sort_by("depth")
        node = pd.Index(frame.column("node").to_pylist())
        place = pd.Index([c + x for c, x in zip(frame.column("comp").to_pylist(), node, strict=True)])
        own = [c + (p or b"") for c, p in zip(frame.column("comp").to_pylist(), frame.column("parent").to_pylist(), strict=True)]
        parent = place.get_indexer(own)  # -1: the parent is in another component
        own_values = np.column_stack([frame.column(v).to_numpy() for v in values]).astype(np.int64)
        out = centroid_totals(parent, own_values) + np.column_stack([frame.column(a).to_numpy() for a in added.values()])
        return pa.table({"node": frame.column("node"), **{v: out[:, i] for i, v in enumerate(values)}})

    dealt = state.select("node", "parent", "depth", "comp", *values, *added.values(), F.pmod(F.xxhash64("comp"), F.lit(buckets)).alias("bucket"))
    return dealt.groupBy("bucket").applyInArrow(totals, "node binary, " + ", ".join(f"{v} long" for v in values))


def ends_digest(paths: DataFrame) -> DataFrame:
    """``(node, ends_sha256)``: SHA-256 of the decimal ids that end at the node, ascending, comma-joined."""
    ends = paths.where(F.col("depth") == F.col("length"))
    blocks = ends.groupBy("node", F.shiftright("conv_id", ID_BLOCK_BITS).alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    joined = blocks.select("node", "block", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, state = None, None
        for batch in batches:
            nodes, out = [], []
            for node, ids in zip(_column(batch, "node"), _column(batch, "ids"), strict=True):
                if node != place:
                    if place is not None:
                        nodes.append(place)
                        out.append(state.hexdigest())
                    place, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.binary()), "ends_sha256": pa.array(out, pa.string())})
        if place is not None:
            yield pa.RecordBatch.from_pydict({"node": [place], "ends_sha256": [state.hexdigest()]})

    return joined.repartition("node").sortWithinPartitions("node", "block").select("node", "ids").mapInArrow(digests, "node binary, ends_sha256 string")


def trie_report(paths: DataFrame, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """A row for every node: members, children, leaves and saved tokens of its subtree, and who ends there."""
    nodes = trie_nodes(paths)
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "node", "left").na.fill(0, ["n_children"])
    nodes = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("size")})
    nodes = materialize(nodes, "trie-nodes")
    totals = subtree_totals(nodes, paths, ["n_leaves", "saved_tokens"], local_nodes)
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.drop("n_leaves", "saved_tokens").join(totals, "node").join(ends_digest(paths), "node", "left")
    out = attach(out, above, ["parent"], spread="node", how="left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(ROOT.hex())).alias("ends_sha256"))
