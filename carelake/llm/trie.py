"""Prefix trie of conversations by recursion on the depth (van Emde Boas order).

Sequences are cut at half depth: the distinct upper halves make an upper trie,
every distinct cut prefix is the root of a lower forest, and both sides are cut
again in the same way.  All subproblems of one level of the recursion are solved in
the same Spark step, so a trie of depth D takes log2 D steps down and as many up:

    contents  the turns of aligned blocks of 1, 2, 4, .. turns, by hashing pairs
    down      a cut prefix is named by its root's name and the block's content;
              level k names the depths whose lowest set bit is 2^k, whose roots
              all have been named by the levels above
    up        the totals of a lower forest are grafted on its cut prefix
              and on the nodes above that one in the upper trie of the same block

Turns stay rows throughout: a conversation is never gathered in a task, and a
node's members are counted by partial aggregates.  Contents and names are
SHA-256 digests, so equal names mean equal prefixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import cut, ranked, union_all

ROOT = b""         # name of the empty prefix
IDS_A_CHUNK = 4096  # members whose ids are gathered at once


def ordered_turns(messages: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): turns numbered from 0 by turn (null first), then role, then text.

    Null roles and texts become empty; rows without a conv_id belong to no
    conversation and are left out.  Positions come from distributed ranks.
    """
    rows = messages.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    out = ranked(rows, ["conv_id", "turn", "role", "text"], groups=["conv_id"])
    return out.select("conv_id", F.col("before").alias("pos"), "role", "text")


def share_openings(turns: DataFrame, block: int = 5, most: int = 9) -> DataFrame:
    """Conversations that begin alike: conversation c opens with the first h turns of conversation c - c % ``block``
    (h by a checksum of c, below ``most``), then goes on with its own turns after its first h."""
    values = [c for c in turns.columns if c not in ("conv_id", "pos")]
    convs = turns.select("conv_id").distinct()
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).alias("h")
    convs = convs.select("conv_id", h, (F.col("conv_id") - F.col("conv_id") % block).alias("base"))
    head = turns.where(F.col("pos") < most - 1).withColumnRenamed("conv_id", "base")
    opening = convs.join(head, "base").where("pos < h").select("conv_id", "pos", *values)
    # turns that the base has to give: its length, as far as h can ask
    length = head.groupBy("base").agg(F.count("*").alias("have"))
    convs = convs.join(length, "base", "left").select("conv_id", "h", F.least("h", F.coalesce("have", F.lit(0))).alias("taken"))
    own = turns.join(convs, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), *values)
    return opening.unionByName(own)


def _digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def turn_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, content, bytes): what the trie needs of a turn, so that texts aren't shuffled any more."""
    # both parts' digests, so that no text can pass for another split
    content = _digest(_digest(F.col("role").cast("binary")), _digest(F.col("text").cast("binary")))
    return turns.select("conv_id", "pos", content.alias("content"), F.octet_length("text").cast("long").alias("bytes"))


def _contents(turns: DataFrame, levels: int) -> list[DataFrame]:
    """By level k: (conv_id, depth, content) of the whole blocks of 2^k turns that end at ``depth``, an odd multiple of 2^k."""
    level = turns.select("conv_id", F.col("pos").alias("block"), "content")
    out = []
    for k in range(levels):
        named = level.where("block % 2 = 0").select("conv_id", ((F.col("block") + 1) * (1 << k)).alias("depth"), "content")
        out.append(named)
        if k + 1 < levels:
            first = F.max(F.when(F.col("block") % 2 == 0, F.col("content")))
            second = F.max(F.when(F.col("block") % 2 == 1, F.col("content")))
            pairs = level.groupBy("conv_id", F.floor(F.col("block") / 2).alias("block")).agg(first.alias("a"), second.alias("b"))
            level = cut(pairs.where("a is not null and b is not null").select("conv_id", "block", _digest(F.col("a"), F.col("b")).alias("content")))
    return out


def name_prefixes(turns: DataFrame) -> tuple[DataFrame, int]:
    """((conv_id, depth, name) for every depth of every conversation, number of levels of the recursion)."""
    deepest = turns.agg(F.max("pos")).first()[0]
    levels = 0 if deepest is None else int(deepest + 1).bit_length()
    found: list[DataFrame] = []
    contents = _contents(turns, levels)
    for k in reversed(range(levels)):
        root = F.col("depth") - (1 << k)
        part = contents[k].withColumn("at", root)
        if found:
            above = union_all(found).select("conv_id", F.col("depth").alias("at"), F.col("name").alias("root"))
            part = part.join(above, ["conv_id", "at"], "left")
        else:
            part = part.withColumn("root", F.lit(ROOT))
        part = part.select("conv_id", "depth", _digest(F.coalesce("root", F.lit(ROOT)), F.col("content")).alias("name"))
        found.append(cut(part))
    return (union_all(found) if found else turns.select("conv_id", F.col("pos").alias("depth"), F.col("content").alias("name")).limit(0)), levels


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, conv_id, ids) in order -> (depth, conv_id, ends_sha256): a node's id strings go through one hash, a piece at a time."""
    node, state = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([state.hexdigest()])],
                                          ["depth", "conv_id", "ends_sha256"])
    for batch in batches:
        for depth, conv, ids in zip(*(batch.column(c).to_pylist() for c in range(3))):
            if node == (depth, conv):
                state.update(b",")
            else:
                if node is not None:
                    yield done()
                node, state = (depth, conv), hashlib.sha256()
            state.update(ids.encode())
    if node is not None:
        yield done()


def member_hashes(ends: DataFrame) -> DataFrame:
    """(depth, conv_id, ends_sha256) for (depth, conv_id, member): the members' ids, ascending, comma-joined, hashed.

    Ids are gathered by ranges of ``IDS_A_CHUNK``; a hash has to see a node's
    ids in one order, so their strings, and nothing else, pass through one task.
    """
    chunk = F.floor(F.col("member") / IDS_A_CHUNK).alias("chunk")
    ids = F.array_join(F.array_sort(F.collect_list("member")), ",").alias("ids")
    chunks = ends.groupBy("depth", "conv_id", chunk).agg(ids)
    chunks = chunks.repartition("depth", "conv_id").sortWithinPartitions("depth", "conv_id", "chunk")
    return chunks.select("depth", "conv_id", "ids").mapInArrow(_hashes, "depth long, conv_id long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row per distinct prefix of the sequences in ``turns`` (conv_id, pos from 0 without gaps, content, bytes):

    conv_id (smallest member) and depth name the node; parent_conv_id;
    n_convs; n_children; n_leaves and saved_tokens (n_convs - 1 times the bytes
    of the node's last text) summed over its subtree, itself included; ends_sha256.

    ``conversations`` (conv_id) adds conversations without turns: they are
    members of the root and end there.  With no conversation at all there is no
    node.  Other columns are left out.
    """
    turns = cut(turns.select("conv_id", "pos", "content", "bytes"))
    everyone = turns.select("conv_id")
    if conversations is not None:
        everyone = everyone.unionByName(conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")))
    everyone = cut(everyone.distinct())
    names, levels = name_prefixes(turns)
    names = names.withColumn("depth", F.col("depth").cast("long"))
    size = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "bytes")
    nodes = names.groupBy("depth", "name").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    nodes = cut(nodes.join(size, ["conv_id", "depth"]))  # all members end a prefix with the same turn
    # the path of every node's smallest member: the node's ancestors by their smallest members
    reps = names.join(nodes.select("conv_id").distinct(), "conv_id", "left_semi")
    path = cut(reps.join(nodes.select("depth", "name", F.col("conv_id").alias("node")), ["depth", "name"])
               .select(F.col("conv_id").alias("via"), "depth", "node"))
    up = path.select(F.col("via").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    nodes = cut(nodes.join(up, ["conv_id", "depth"], "left").select("depth", "name", "conv_id", "n_convs", "parent",
                                                                   ((F.col("n_convs") - 1) * F.col("bytes")).alias("own")))
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("conv_id")).agg(F.count("*").alias("n_children"))
    totals = nodes.where("depth > 0").select("depth", "conv_id", "parent", F.col("own").alias("saved")).join(
        children.where("depth > 0"), ["depth", "conv_id"], "left")
    totals = totals.select("depth", "conv_id", "parent", F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"), "saved")
    for k in range(levels):
        totals = cut(_graft(totals, path, 1 << k))
    return _with_root(nodes, totals, children, names, everyone)


def _graft(totals: DataFrame, path: DataFrame, half: int) -> DataFrame:
    """Totals within blocks of ``half`` depths -> within blocks of twice as many."""
    # the forests that hang below the depths where an upper block ends
    tops = totals.where(((F.col("depth") - 1) % (2 * half) == half) & F.col("parent").isNotNull())
    forests = tops.groupBy((F.col("depth") - 1).alias("cut"), F.col("parent").alias("via")).agg(
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    above = forests.join(path, "via").where((F.col("depth") <= F.col("cut")) & (F.col("depth") > F.col("cut") - half))
    grafts = above.groupBy("depth", F.col("node").alias("conv_id")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
    both = totals.join(grafts, ["depth", "conv_id"], "left")
    return both.select("depth", "conv_id", "parent", (F.col("leaves") + F.coalesce("_l", F.lit(0))).alias("leaves"),
                       (F.col("saved") + F.coalesce("_s", F.lit(0))).alias("saved"))


def _with_root(nodes: DataFrame, totals: DataFrame, children: DataFrame, names: DataFrame, everyone: DataFrame) -> DataFrame:
    """The nodes' rows, the root's among them."""
    root = everyone.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")  # one row at most
    first = totals.where("depth = 1").agg(F.count("*").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    root = root.crossJoin(F.broadcast(first)).select(  # one row by one row
        F.lit(0).cast("long").alias("depth"), "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"))
    least = root.select(F.col("conv_id").alias("parent_conv_id"))
    below = nodes.join(totals.drop("parent"), ["depth", "conv_id"]).join(children, ["depth", "conv_id"], "left")
    below = below.crossJoin(F.broadcast(least)).select(  # the root's one row
        "depth", "conv_id", F.coalesce("parent", "parent_conv_id").alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.col("leaves").cast("long").alias("n_leaves"),
        F.col("saved").cast("long").alias("saved_tokens"))
    last = names.groupBy("conv_id").agg(F.max(F.struct("depth", "name")).alias("last"))
    ends = everyone.join(last, "conv_id", "left").select(F.col("conv_id").alias("member"), "last.depth", "last.name")
    at_nodes = ends.where("depth is not null").join(nodes.select("depth", "name", "conv_id"), ["depth", "name"]).select("depth", "conv_id", "member")
    at_root = ends.where("depth is null").select("member").crossJoin(F.broadcast(root.select("depth", "conv_id")))  # one row
    hashes = member_hashes(at_nodes.unionByName(at_root.select("depth", "conv_id", "member")))
    empty = F.sha2(F.lit(""), 256)
    out = below.unionByName(root).join(hashes, ["depth", "conv_id"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", empty).alias("ends_sha256"))
