"""Prefix trie of conversations by splitters: sorted shards and a skeleton.

A conversation is a path of turns, each named by a digest of role and text. Equal paths are brought
together first (count, smallest id), then the distinct paths are dealt to shards by their order. The
first path of each shard is a splitter, and the trie of the splitters is the skeleton. It is broadcast:
a few paths for each shard. A node outside it lies within one shard, where a walk over the sorted
paths, with the open nodes on a stack, finishes it. A node of the skeleton can lie in several shards;
each gives a partial aggregate, and a reduction combines these. What can only be known of a whole node
(saved tokens, whether it is a leaf) is then added to its ancestors inside the skeleton.

Paths are cut into blocks of ``BLOCK`` turns, so no row grows with the length of a conversation: a block
begins at a node that is named by the parity of its turns' numbered digests and is a path of its own.
What lies in later blocks (leaves, saved tokens) is found there first and given to the smallest member
of the place where they begin; each earlier node sums it over its members.

Digests of the members that end at a node are made by streaming sorted ids through SHA-256, as its
input is one sequence by definition; no list of members is held.

Defined cases: rows with a null conversation id belong to no conversation and are left out; null role
and text are empty; turns are ordered by turn, null first, then role, then the first 64 characters of the
text, then the text's digest, so repeated rows are turns of their own; an empty table has no nodes;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Turns of a path that stand in one row, and distinct paths of a shard.
BLOCK = 256
SHARD_ROWS = 50_000
#: Every GROUP conversations share the first turns of the first of them.
GROUP = 20
HEADS = 4
WORD = "[^\\x20\\x09-\\x0D]+"
NODE = "block int, depth int, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends string, skeleton int, parent_skeleton int"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def numbered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, k, digest, words)``: turns by their place, from 1."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        role.alias("role"),
        F.substring(text, 1, 64).alias("start"),
        F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).alias("words"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "start", "digest")
    return rows.select("conv_id", "digest", "words", F.row_number().over(order).alias("k"))


def rebuilt(turns: DataFrame, **cols: str) -> DataFrame:
    """``(conv_id, pos, digest, words)`` of the rebuilt conversations, and a row with a null digest at
    place 0 for each of them: the first h turns of the first conversation of its twenty, then its own
    turns after the first h, where h is the CRC-32 of its id modulo ``HEADS``."""
    rows = common.stored(numbered(turns, **cols))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    heads = rows.filter((F.col("conv_id") % GROUP == 0) & (F.col("k") < HEADS)).groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("k", "digest", "words"))).alias("heads"))  # three at most
    # every conversation has one first turn
    convs = rows.filter(F.col("k") == 1).select("conv_id", h.alias("h"), base.alias("base")).join(heads, "base", "left")
    convs = convs.select("conv_id", "h", F.slice(F.coalesce("heads", F.array()), F.lit(1), F.col("h")).alias("heads"))
    own = rows.join(convs, "conv_id").filter(F.col("k") > F.col("h")).select("conv_id", (F.col("k") - F.col("h") + F.size("heads")).alias("pos"), "digest", "words")
    first = convs.select("conv_id", F.explode("heads").alias("t")).select("conv_id", F.col("t.k").alias("pos"), "t.digest", "t.words")
    return own.unionByName(first).unionByName(convs.select("conv_id", F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("words")))


def blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(conv_id, block, path, words, last)``: the paths in blocks. The first step of a path names the node
    where its block begins: the block's number and a name of all turns before it. A conversation ends
    inside its last block, which can be empty."""
    dealt = rows.withColumn("block", F.greatest(F.floor((F.col("pos") - 1) / block), F.lit(0)).cast("int"))
    # where a block is full, the conversation also has the next one, be it empty
    more = dealt.filter((F.col("pos") > 0) & (F.col("pos") % block == 0)).select("conv_id", F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("words"), (F.col("block") + 1).alias("block"))
    turn = F.col("pos") > 0
    found = dealt.unionByName(more).groupBy("conv_id", "block").agg(
        F.sort_array(F.collect_list(F.when(turn, F.struct("pos", "digest", "words")))).alias("t"),
        *[F.bit_xor(F.when(turn, F.xxhash64(F.lit(seed), "pos", "digest"))).alias(c) for seed, c in ((1, "p"), (2, "q"))],
    )
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    name = F.concat(F.lpad(F.hex("block"), 8, "0"), *[F.lpad(F.hex(F.coalesce(F.bit_xor(c).over(before), F.lit(0))), 16, "0") for c in ("p", "q")])
    return found.select(
        "conv_id",
        "block",
        F.concat(F.array(F.unhex(name)), F.col("t.digest")).alias("path"),
        F.concat(F.array(F.lit(0)), F.col("t.words")).alias("words"),
        (F.size("t") < block).alias("last"),
    )


def _key() -> Column:
    """A short name of a block's path."""
    return F.substring(F.unhex(F.sha2(F.unhex(F.array_join(F.transform("path", F.hex), "")), 256)), 1, 16).alias("key")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids sorted within their keys to a digest for each key; a key can span any number of batches."""
    key, sha, keys, ends = None, None, [], []
    for b in batches:
        names, ids, at = b["key"].to_pylist(), b["conv_id"].to_pylist(), 0
        while at < len(ids):
            to = at
            while to < len(ids) and names[to] == names[at]:
                to += 1
            part = ",".join(map(str, ids[at:to])).encode()
            if names[at] == key:
                sha.update(b"," + part)
            else:
                if sha:
                    keys.append(key)
                    ends.append(sha.hexdigest())
                key, sha = names[at], hashlib.sha256(part)
            at = to
        yield pa.record_batch({"key": pa.array(keys, pa.binary()), "ends": pa.array(ends, pa.string())})
        keys, ends = [], []
    if sha:
        yield pa.record_batch({"key": pa.array([key], pa.binary()), "ends": pa.array([sha.hexdigest()])})


def end_digests(parts: DataFrame) -> DataFrame:
    """``(key, ends)``: for each path, the digest of the sorted ids of the conversations that end with it."""
    ended = parts.filter("last").select(_key(), "conv_id")
    return ended.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_streamed, "key binary, ends string")


class Skeleton:
    """The trie of the splitters. Its top (0) is no node of the trie of conversations: below it are the roots of blocks."""

    def __init__(self, splitters: list[tuple[list[bytes], list[int]]]):
        self.children: list[dict[bytes, int]] = [{}]
        self.parent, self.words = [-1], [0]
        for path, words in sorted(splitters):
            at = 0
            for step, count in zip(path, words):
                if step not in self.children[at]:
                    self.children[at][step] = len(self.children)
                    self.parent.append(at)
                    self.words.append(count)
                    self.children.append({})
                at = self.children[at][step]

    def above(self, n: int) -> list[int]:
        """``n`` and its ancestors, without the top."""
        out = []
        while n:
            out.append(n)
            n = self.parent[n]
        return out

    def rows(self) -> list[tuple[int, int, int, int, list[int]]]:
        return [(n, self.parent[n], self.words[n], len(self.children[n]), self.above(n)) for n in range(1, len(self.children))]


class _Open:
    """A node on the stack of a walk; ``skeleton`` is its place there, or -1."""

    __slots__ = ("step", "words", "skeleton", "n", "conv", "children", "leaves", "saved", "goes_on", "ends", "below")

    def __init__(self, step: bytes, words: int, skeleton: int):
        self.step, self.words, self.skeleton = step, words, skeleton
        self.n = self.children = self.leaves = self.saved = 0
        self.conv, self.goes_on, self.ends, self.below = None, False, None, []


def _walk(batches: Iterator[pa.RecordBatch], skeleton: Skeleton) -> Iterator[pa.RecordBatch]:
    """Nodes of shards whose paths are sorted: whole ones, and partial ones of the skeleton."""
    stack: list[_Open] = []
    done: list[list] = []
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 6, pa.string(), pa.int32(), pa.int32()]
    names = [x.split()[0] for x in NODE.split(", ")]

    def pop() -> None:
        node = stack.pop()
        up = stack[-1] if stack else None
        if node.skeleton < 0:
            node.saved += (node.n - 1) * node.words
            # a node where a block ends has its children in the next one, and is counted as a leaf there
            node.leaves += not node.children and not node.goes_on
        block = int.from_bytes((stack[0] if stack else node).step[:4], "big")
        row = [block, len(stack), node.conv, None, node.n, node.children, node.leaves, node.saved, node.ends, node.skeleton if node.skeleton >= 0 else None, None]
        for child in node.below:
            child[3] = node.conv
        done.extend(node.below)
        if up is None or up.skeleton >= 0:
            row[-1] = up.skeleton if up else None
            done.append(row)
        else:
            up.below.append(row)
        if up:
            up.n += node.n
            up.conv = node.conv if up.conv is None else min(up.conv, node.conv)
            up.children += node.skeleton < 0
            up.leaves += node.leaves
            up.saved += node.saved

    def handed() -> pa.RecordBatch:
        out = pa.record_batch([pa.array([r[i] for r in done], kind) for i, kind in enumerate(kinds)], names)
        done.clear()
        return out

    for b in batches:
        for row in b.to_pylist():
            path, same = row["path"], 0
            while same < len(stack) and same < len(path) and stack[same].step == path[same]:
                same += 1
            while len(stack) > same:
                pop()
            for step, words in zip(path[same:], row["words"][same:]):
                at = stack[-1].skeleton if stack else 0
                stack.append(_Open(step, words, skeleton.children[at].get(step, -1) if at >= 0 else -1))
            end = stack[-1]
            end.n += row["n"]
            end.conv = row["conv_id"] if end.conv is None else min(end.conv, row["conv_id"])
            end.children += row["next_children"]
            end.leaves += row["more_leaves"]
            end.saved += row["more_saved"]
            end.goes_on, end.ends = not row["last"], row["ends"]
            if len(done) > 10_000:
                yield handed()
    while stack:
        pop()
    yield handed()


def nodes(parts: DataFrame, block: int, shard_rows: int) -> DataFrame:
    """``NODE`` for every node of the blocks' tries, its ``depth`` counted from where the block begins.
    ``parts`` also has what is known of later blocks."""
    spark = parts.sparkSession
    shards = max(1, -(-parts.count() // shard_rows))
    paths = parts.groupBy("path", "words", "last").agg(
        F.count("*").alias("n"),
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("next_children", "more_leaves", "more_saved")],
    )
    # of the members of a node where a block ends, one carries the digest
    ends = end_digests(parts).unionByName(parts.filter("next_ends is not null").select(_key(), F.col("next_ends").alias("ends")))
    paths = paths.withColumn("key", _key()).join(ends, "key", "left").drop("key")
    sharded = common.stored(paths.repartitionByRange(shards, "path").withColumn("shard", F.spark_partition_id()))
    splitters = sharded.groupBy("shard").agg(F.min(F.struct("path", "words")).alias("first")).collect()
    skeleton = Skeleton([([bytes(x) for x in r["first"]["path"]], r["first"]["words"]) for r in splitters])
    sent = spark.sparkContext.broadcast(skeleton)
    found = common.stored(sharded.repartition(shards, "shard").sortWithinPartitions("shard", "path").mapInArrow(lambda b: _walk(b, sent.value), NODE))

    inner = spark.createDataFrame(skeleton.rows(), "skeleton int, parent_skeleton int, words bigint, skeleton_children bigint, above array<int>")
    whole = found.filter("skeleton is not null").groupBy("skeleton", "block", "depth").agg(
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("ends").alias("ends"),
    )
    whole = whole.join(inner, "skeleton").withColumn("n_children", F.col("n_children") + F.col("skeleton_children"))
    leaf = ((F.col("n_children") == 0) & (F.col("depth") < block)).cast("bigint")
    own = whole.select(F.explode("above").alias("skeleton"), leaf.alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("own"))
    own = own.groupBy("skeleton").agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own"))
    convs = whole.select(F.col("skeleton").alias("parent_skeleton"), F.col("conv_id").alias("parent_conv_id"))
    whole = whole.join(own, "skeleton").join(convs, "parent_skeleton", "left")
    columns = ["block", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    whole = whole.withColumn("n_leaves", F.col("n_leaves") + F.col("leaf")).withColumn("saved_tokens", F.col("saved_tokens") + F.col("own")).select(columns)
    rest = found.filter("skeleton is null").join(convs.withColumnRenamed("parent_conv_id", "up"), "parent_skeleton", "left")
    return whole.unionByName(rest.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up")).select(columns))


def trie(turns: DataFrame, block: int = BLOCK, shard_rows: int = SHARD_ROWS, **cols: str) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations."""
    parts = common.stored(blocks(rebuilt(turns, **cols), block))
    nothing = {"next_children": F.lit(0).cast("bigint"), "more_leaves": F.lit(0).cast("bigint"), "more_saved": F.lit(0).cast("bigint"), "next_ends": F.lit(None).cast("string")}
    plain = parts.withColumns(nothing)
    later = plain.filter("block > 0")
    if not later.isEmpty():
        roots = nodes(later, block, shard_rows).filter("depth = 0").select("block", "conv_id", F.col("n_children").alias("c"), F.col("n_leaves").alias("l"), F.col("saved_tokens").alias("s"), F.col("ends").alias("e"))
        down = Window.partitionBy("conv_id").orderBy(F.desc("block"))
        deeper = down.rowsBetween(Window.unboundedPreceding, -1)
        long = parts.filter("block > 0 or not last").join(roots, ["conv_id", "block"], "left")
        long = long.select(
            *parts.columns,
            F.coalesce(F.lag("c").over(down), F.lit(0)).alias("next_children"),
            F.coalesce(F.sum("l").over(deeper), F.lit(0)).alias("more_leaves"),
            F.coalesce(F.sum("s").over(deeper), F.lit(0)).alias("more_saved"),
            F.lag("e").over(down).alias("next_ends"),
        )
        plain = common.stored(plain.filter("block = 0 and last").unionByName(long))
    found = nodes(plain, block, shard_rows).filter("block = 0 or depth > 0")
    return found.select(
        "conv_id",
        (F.col("block").cast("bigint") * block + F.col("depth")).alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
