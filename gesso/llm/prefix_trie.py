"""The prefix trie of conversations, from vertical bitmaps.

Conversations are cut into shards of ``SHARD`` in order of their ids. A shard
indexes each (position, turn) to the set of its conversations that have this
turn there, a bitset. From the root, which holds all, the conversations of a
node are taken apart depth first: the intersection with the posting of a
member's next turn is a child, its popcount the members, and what no child
takes ends here. Nodes are named by a hash of their path, so those of the
shards are summed by name.

What is summed over subtrees goes by chains, without rounds: the nodes with
one smallest member ``c`` are the lower end of c's path, and what lies below a
node is the rest of its own chain, and the whole chains of those of its other
members whose chain starts below it.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import batched

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gesso.session import keep

#: conversations of a shard, and turns after which one is closed even so
SHARD, SHARD_TURNS = 4096, 200_000
ROOT = bytes(16)
_TREE = "kind string, shard long, name binary, parent binary, depth long, conv_id long, n_convs long, bytes long, ends string, path array<binary>"
_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
_ARROW = pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in _TREE.split(", ")])


def borrowed_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the one it follows: CRC-32 of its decimal id, modulo 9."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 9).cast("int")


def numbered(conversations: DataFrame) -> DataFrame:
    """``conv_id, position, role, text``: turns counted from 0, null turns first, ties by role and text; null strings are empty, rows without ``conv_id`` belong to none."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.withColumn("position", F.row_number().over(order) - 1).drop("turn")


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv_id, place, digest, bytes`` of the rebuilt turns; a conversation without any has one row with a null ``place``.

    The first h turns come from conversation ``c - c % 5``, the rest are the
    conversation's own after its first h. Only first turns are borrowed, at
    most 8 a conversation, so the join's one side has at most 8 rows an id.
    """
    digest = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", F.col("text")).cast("binary")))
    marked = keep(turns.select("conv_id", "position", digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes")), "turns")
    ids = marked.where(F.col("position") == 0).select("conv_id", borrowed_turns(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    first = marked.where(F.col("position") < 8).select(F.col("conv_id").alias("base"), F.col("position").alias("place"), "digest", "bytes")
    heads = ids.join(first, "base").where(F.col("place") < F.col("h")).select("conv_id", F.col("place").cast("long").alias("place"), "digest", "bytes")
    h = borrowed_turns(F.col("conv_id"))
    tails = marked.where(F.col("position") >= h).select("conv_id", F.col("position").cast("long").alias("place"), "digest", "bytes")
    none = ids.select("conv_id", F.lit(None).cast("long").alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("bytes"))
    return heads.union(tails).union(none)


def shard_nodes(paths: list[tuple[int, list[bytes], list[int]]]) -> Iterator[tuple]:
    """Nodes and end lists of one shard of ``(conv_id, turns, bytes)`` in order of id, then the path of each conversation.

    A bitset is a Python integer, bit i for the i-th conversation.
    """
    postings: dict[tuple[int, bytes], int] = {}
    for i, (_, turns, _) in enumerate(paths):
        for at, turn in enumerate(turns):
            postings[at, turn] = postings.get((at, turn), 0) | 1 << i
    stack: list[tuple] = [((1 << len(paths)) - 1, 0, ROOT, None, 0)] if paths else []
    trail: list[bytes] = []
    while stack:
        members, depth, name, parent, size = stack.pop()
        del trail[depth:]
        trail.append(name)
        first = (members & -members).bit_length() - 1
        left, ends = members, []
        while left:
            i = (left & -left).bit_length() - 1
            _, turns, sizes = paths[i]
            if len(turns) == depth:
                ends.append(paths[i][0])
                left &= left - 1
                continue
            child = members & postings[depth, turns[depth]]
            left &= ~child
            stack.append((child, depth + 1, xxhash.xxh128_digest(name + turns[depth]), name, sizes[depth]))
        yield "node", name, parent, depth, paths[first][0], members.bit_count(), size, ",".join(map(str, ends)), None
        for c in ends:
            yield "path", None, None, depth, c, None, None, None, list(trail)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of a sorted partition, shard by shard."""
    held: list[tuple[int, list[bytes], list[int]]] = []
    turns = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for rows in batched(((row[0], held[0][0], *row[1:]) for row in shard_nodes(held)), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    for batch in batches:
        for conv_id, place, digest, size in zip(*(batch[c].to_pylist() for c in ("conv_id", "place", "digest", "bytes")), strict=True):
            if not held or held[-1][0] != conv_id:
                if len(held) >= SHARD or turns >= SHARD_TURNS:
                    yield from flush()
                    held, turns = [], 0
                held.append((conv_id, [], []))
            if place is not None:
                held[-1][1].append(digest)
                held[-1][2].append(size)
                turns += 1
    if held:
        yield from flush()



def sharded_tries(turns: DataFrame) -> DataFrame:
    """The tries of all shards (rows of kind ``node``) and the path of each conversation (kind ``path``) from ``rebuilt`` rows."""
    spread = turns.repartitionByRange("conv_id").sortWithinPartitions("conv_id", F.col("place").asc_nulls_first())
    return spread.mapInArrow(_shards, _TREE)


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined end lists of each name, fed piece by piece from rows sorted by name and shard."""
    now, digest = None, None
    for batch in batches:
        names, out = [], []
        for name, ends in zip(batch["name"].to_pylist(), batch["ends"].to_pylist(), strict=True):
            if name != now:
                if now is not None:
                    names.append(now)
                    out.append(digest.hexdigest())
                now, digest = name, sha256(ends.encode())
            else:
                digest.update(b"," + ends.encode())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(out, pa.string())], names=["name", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["name", "ends_sha256"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt ``conversations(conv_id, turn, role, text)``, a row a node.

    ``conv_id`` the smallest member, ``depth``, ``parent_conv_id`` (null for
    the root), ``n_convs``, ``n_children``, ``n_leaves`` and ``saved_tokens``
    of the subtree, ``ends_sha256`` of the ids that end in the node. An empty
    table has no nodes. Other columns are ignored.
    """
    tries = keep(sharded_tries(rebuilt(numbered(conversations))), "tries")
    parts = tries.where(F.col("kind") == "node")
    summed = parts.groupBy("name").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.first("bytes").alias("bytes"))
    nodes = keep(summed, "nodes")
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    listed = parts.where(F.col("ends") != "").select("name", "shard", "ends")
    ends = listed.repartition("name").sortWithinPartitions("name", "shard").mapInArrow(_end_digests, "name binary, ends_sha256 string")
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    known = nodes.join(children, "name", "left").join(ends, "name", "left")
    known = keep(known.withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("long")), "saved": saved, "leaf": F.col("n_children").isNull().cast("long"), "ends_sha256": F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest()))}), "known")
    # each node's own chain from it down, and each chain as a whole
    down = Window.partitionBy("conv_id").orderBy(F.col("depth").desc())
    below = known.withColumns({"leaves_down": F.sum("leaf").over(down), "saved_down": F.sum("saved").over(down)})
    chains = known.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    paths = tries.where(F.col("kind") == "path").select("conv_id", "path")
    above = paths.join(chains, "conv_id").select(F.explode(F.slice("path", F.lit(1), F.col("top").cast("int"))).alias("name"), "leaves", "saved")
    hung = above.groupBy("name").agg(F.sum("leaves").alias("leaves_hung"), F.sum("saved").alias("saved_hung"))
    owners = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    zero = F.lit(0).cast("long")
    return (
        below.join(hung, "name", "left")
        .join(owners, "parent", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
            (F.col("leaves_down") + F.coalesce("leaves_hung", zero)).alias("n_leaves"),
            (F.col("saved_down") + F.coalesce("saved_hung", zero)).alias("saved_tokens"), "ends_sha256",
        )
    )
