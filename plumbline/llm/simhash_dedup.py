"""SimHash near-duplicates by a binary trie self-join.

Fingerprints
    A document is lower-cased in A-Z, cut into words at ASCII white space, and its word shingles
    are hashed with XXH64. Bit b of the fingerprint is 1 if it is 1 in over half of the hashes.
    ``n_hashes`` fingerprints of 64 bits are made with seeds ``seed, seed + 1, ...``.

Links
    Distinct fingerprints only take part, so copies never multiply. All fingerprints within
    ``radius`` bits of each other are found by traversing pairs of nodes of a binary trie
    together: the bits that differ accumulate along the way and a pair of nodes is given up when
    they exceed the budget. The fingerprint is read in ``blocks`` rotations; by the pigeonhole
    principle on a ring, two fingerprints within the radius have a rotation in which the first j
    blocks differ in at most ``radius * j // blocks`` bits for every j, so each rotation can use
    that tighter budget and no pair within the radius is lost.

    The nodes at the depth of the first block are Spark's partitioning keys: a fingerprint goes to
    the pairs of nodes within the first budget, and a pair of nodes with more than ``NODE_ROWS``
    fingerprints goes one block deeper, ``SPLITS`` times at most. What is still larger is cut into chunks
    of that size, each two of which meet under a key of their own, so no task holds an unbounded node.

Similarity
    The stage of the pipeline takes linked fingerprints as candidates only. Of each distinct set of
    shingles among them one text is read again, and two sets are joined if their exact Jaccard
    similarity reaches the limit. Two such sets share a shingle among the rarest of each
    (``n - ceil(limit * n) + 1`` of n), so sets meet at those shingles: first with the smallest and
    the largest set of each, which joins groups of copies by few pairs, then all that are still apart
    and whose parities (a lower bound of what they differ by, 64 bytes a set) leave the limit open.

Components
    Smallest node reachable over links, by rounds of contraction on DataFrames.

Defined cases: null text is the empty text; no words gives fingerprint zero, linked like any
other; fewer words than a shingle give one shingle of them all; repeated rows keep their own
result rows; a null id keeps its row and takes the smallest id of its component (null if there is
none); empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Most fingerprints in a pair of nodes before it is split by its next block.
NODE_ROWS = 2048
#: Most blocks that a pair of nodes goes down before it is cut into chunks: masks multiply.
SPLITS = 3
#: Node pairs with this many fingerprint pairs or fewer are compared outright.
LEAF_PAIRS = 256
#: Bounds of a task's memory: fingerprints and pairs compared at once.
ROWS_AT_ONCE = 30_000
#: Most removed rows whose numbers are sent to all tasks (32 MB); beyond it the texts are shuffled.
GONE_ROWS = 4_000_000
PAIRS_AT_ONCE = 500_000
#: Most rounds that join similar sets by few pairs before all pairs still apart are compared.
STAR_ROUNDS = 2
#: Words of parity bits of a set of shingles.
PARITIES = 8


# ------------------------------------------------------------------ fingerprints
def shingle_hashes(text: str, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lens + 1)[:-1]))
    n = max(1, len(words) - shingle + 1)
    ends = (starts + lens)[min(shingle, len(words)) - 1 :][:n]
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), ends.tolist())), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is 1 in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int((np.uint64(1) << np.arange(64, dtype=np.uint64))[2 * ones > len(hashes)].sum(dtype=np.uint64))


def set_key(hashes: np.ndarray) -> bytes:
    """128 bits that name the set of the hashes."""
    import xxhash

    return xxhash.xxh3_128_digest(np.unique(hashes).astype("<u8").tobytes())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, n_hashes: int = 1, keys: bool = False) -> DataFrame:
    """``(doc_id, fp0, fp1, ...)``: a row for each row of ``docs``; fingerprints as signed bigints.
    With ``keys`` also ``set_key``, the name of the set of shingles."""
    common.bound_batches(docs.sparkSession)
    names = [f"fp{k}" for k in range(n_hashes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            prints, sets = np.empty((n_hashes, b.num_rows), np.uint64), []
            for i, t in enumerate(b.column(1).to_pylist()):
                for k in range(n_hashes):
                    hashes = shingle_hashes(t, shingle, seed + k)
                    prints[k, i] = fingerprint(hashes)
                    if keys and k == 0:
                        sets.append(set_key(hashes))
            cols = [pa.array(c.view(np.int64)) for c in prints]
            more = [pa.array(sets, pa.binary())] if keys else []
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, *more], names=["doc_id", *names, *["set_key"][: len(more)]])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), common.text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, " + ", ".join(f"{n} bigint" for n in names) + (", set_key binary" if keys else ""))


def parities(hashes: np.ndarray) -> np.ndarray:
    """``PARITIES`` words of bits, each the parity of the number of hashes in a bucket. Each element that only
    one of two sets has flips one bit, so two sets differ in at least as many elements as their bits do."""
    odd = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % (64 * PARITIES), minlength=64 * PARITIES) % 2
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int, seed: int) -> DataFrame:
    """``(node, hashes, bits)``: the distinct shingle hashes of each row of ``docs``, and their parities."""
    common.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            sets = [np.unique(shingle_hashes(t, shingle, seed)) for t in b.column(1).to_pylist()]
            columns = [b.column(0), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array([parities(x) for x in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "hashes", "bits"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("node"), common.text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "node bigint, hashes array<bigint>, bits array<bigint>")


# ------------------------------------------------------------------ trie self-join
def budgets(radius: int, blocks: int) -> list[int]:
    """Most differing bits in the first j blocks of a rotation, for j = 1 ... blocks."""
    return [radius * j // blocks for j in range(1, blocks + 1)]


def _masks(width: int, most: int) -> list[int]:
    return [m for m in range(1 << width) if m.bit_count() <= most]


def _rotate(fp: np.ndarray, bits: np.ndarray) -> np.ndarray:
    left = bits.astype(np.uint64)
    return np.where(left == 0, fp, (fp << left) | (fp >> ((np.uint64(64) - left) % np.uint64(64))))


def _expand(a_lo, a_n, b_lo, b_n):
    """All pairs of positions of the ranges [a_lo, a_lo + a_n) and [b_lo, b_lo + b_n)."""
    n = a_n * b_n
    which = np.repeat(np.arange(len(n)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return a_lo[which] + at // b_n[which], b_lo[which] + at % b_n[which]


def trie_pairs(fp: np.ndarray, lo: np.ndarray, hi: np.ndarray, radius: int, allowed: list[int], depth: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions in ``fp`` within ``radius`` bits, inside each of the ranges [lo, hi).

    ``fp`` is sorted inside each range. The ranges are the roots; node pairs go down a bit at a
    time: equal children keep the difference, unequal ones add one, and a node pair over the
    budget of its depth is dropped.
    """
    a_lo, a_hi, b_lo, b_hi, diff = lo, hi, lo, hi, np.zeros(len(lo), np.int64)
    while len(a_lo):
        done = ((a_hi - a_lo) * (b_hi - b_lo) <= LEAF_PAIRS) | (depth >= 64)
        if done.any():
            for at in np.array_split(np.flatnonzero(done), max(1, int(((a_hi - a_lo) * (b_hi - b_lo))[done].sum() // PAIRS_AT_ONCE))):
                i, j = _expand(a_lo[at], (a_hi - a_lo)[at], b_lo[at], (b_hi - b_lo)[at])
                near = (i < j) & (np.bitwise_count(fp[i] ^ fp[j]) <= radius)
                yield i[near], j[near]
        a_lo, a_hi, b_lo, b_hi, diff = (x[~done] for x in (a_lo, a_hi, b_lo, b_hi, diff))
        if not len(a_lo):
            return
        bit = np.uint64(1 << (63 - depth))
        ones = np.concatenate(([0], np.cumsum((fp & bit) == 0)))  # inside a node the zeros come first
        a_mid, b_mid = a_lo + ones[a_hi] - ones[a_lo], b_lo + ones[b_hi] - ones[b_lo]
        same = (a_lo == b_lo) & (a_hi == b_hi)
        parts = [(a_lo, a_mid, b_lo, b_mid, diff), (a_mid, a_hi, b_mid, b_hi, diff), (a_lo, a_mid, b_mid, b_hi, diff + 1)]
        # a node with itself has the unequal children once
        parts.append(tuple(x[~same] for x in (a_mid, a_hi, b_lo, b_mid, diff + 1)))
        a_lo, a_hi, b_lo, b_hi, diff = (np.concatenate(x) for x in zip(*parts))
        depth += 1
        keep = (a_hi > a_lo) & (b_hi > b_lo) & (diff <= allowed[min(len(allowed) - 1, (depth - 1) // width)])
        a_lo, a_hi, b_lo, b_hi, diff = (x[keep] for x in (a_lo, a_hi, b_lo, b_hi, diff))


def _labels(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest position that each position is connected to."""
    label = np.arange(n)
    if not pairs:
        return label
    a, b = (np.concatenate(x) for x in zip(*pairs))
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            return label


def _linked(radius: int, blocks: int, confirm: int | None):
    """Partition function: rows (rot, key, fp0, fp1) sorted by key; links inside each key as stars."""
    allowed, width = budgets(radius, blocks), 64 // blocks

    def links(rot: np.ndarray, key: list[np.ndarray], fp: np.ndarray, other: np.ndarray):
        turned = _rotate(fp, rot * width)
        order = np.lexsort((turned, *key[::-1]))
        turned, other, own = turned[order], other[order], fp[order]
        change = np.zeros(len(fp), bool)
        change[0] = True
        for k in key:
            change[1:] |= k[order][1:] != k[order][:-1]
        lo = np.flatnonzero(change)
        hi = np.append(lo[1:], len(fp))
        many = hi - lo > 1
        found = []
        # the whole fingerprint counts towards the budget, so the traversal starts at the root
        for i, j in trie_pairs(turned, lo[many], hi[many], radius, allowed, 0, width):
            if confirm is not None:
                near = np.bitwise_count(turned[i] ^ turned[j]).astype(np.int64) + np.bitwise_count(other[i] ^ other[j]) <= confirm
                i, j = i[near], j[near]
            if len(i):
                found.append((i, j))
            if sum(len(x[0]) for x in found) > 2 * PAIRS_AT_ONCE:
                label = _labels(len(fp), found)
                rest = np.flatnonzero(label != np.arange(len(fp)))
                found = [(rest, label[rest])]
        label = _labels(len(fp), found)
        # each component as a star around its smallest fingerprint: a cluster that meets under many
        # keys gives the same links under each
        by_value = np.lexsort((other, own))
        rank = np.empty(len(fp), np.int64)
        rank[by_value] = np.arange(len(fp))
        best = np.full(len(fp), len(fp))
        np.minimum.at(best, label, rank)
        hub = by_value[best[label]]
        at = np.flatnonzero(hub != np.arange(len(fp)))
        return own[at], other[at], own[hub[at]], other[hub[at]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0

        def flush(cols: list[np.ndarray]):
            if not len(cols[0]):
                return
            a, a2, b, b2 = links(cols[0], cols[:2], cols[2].view(np.uint64), cols[3].view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, a2, b, b2)], names=["a0", "a1", "b0", "b1"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([np.asarray(c) for c in batch.columns])
            rows += batch.num_rows
            if rows >= ROWS_AT_ONCE:  # whole keys only; the last key may go on in the next batch
                cols = [np.concatenate(x) for x in zip(*held)]
                cut = int(np.flatnonzero((cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]))[0])
                yield from flush([c[:cut] for c in cols])
                held, rows = [[c[cut:] for c in cols]], len(cols[0]) - cut
        if held:
            yield from flush([np.concatenate(x) for x in zip(*held)])

    return run


def trie_links(fps: DataFrame, radius: int = 3, blocks: int = 4, confirm: int | None = None, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links between distinct fingerprints ``(fp0[, fp1])``: ``(a0, a1, b0, b1)``, enough to connect
    every two within ``radius`` bits of ``fp0`` (and ``confirm`` bits of both words, if given).

    A key is a pair of nodes at some depth, written as the first node's prefix and the mask of
    bits in which the second differs, so both orders of a pair give one key.
    """
    width, allowed = 64 // blocks, budgets(radius, blocks)
    two = "fp1" in fps.columns
    base = fps.select("fp0", *(["fp1"] if two else [F.lit(0).cast("bigint").alias("fp1")])).distinct()
    base = base.select("fp0", "fp1", F.explode(F.array(*(F.lit(r) for r in range(blocks)))).alias("rot"))

    def block(j: int):
        """Bits of block j of the rotation, as a long."""
        at = (F.col("rot") + j) % blocks
        return F.call_function("shiftrightunsigned", F.col("fp0"), (F.lit(64 - width) - at * width).cast("int")).bitwiseAND(F.lit((1 << width) - 1))

    def spread(rows: DataFrame, j: int) -> DataFrame:
        """Each row to the node pairs that it belongs to after block j: (smaller node, mask)."""
        masks = [m for m in _masks(width, allowed[j])] if allowed[j] else [0]
        rows = rows.withColumn("node", block(j)).withColumn("mask", F.explode(F.array(*(F.lit(m).cast("bigint") for m in masks))))
        rows = rows.filter(F.col("used") + F.bit_count("mask") <= allowed[j])
        low = F.least(F.col("node"), F.col("node").bitwiseXOR(F.col("mask")))
        return rows.select("fp0", "fp1", "rot", F.xxhash64("key", "rot", low, "mask", F.lit(j)).alias("key"), (F.col("used") + F.bit_count("mask")).alias("used"))

    rows = spread(base.withColumns({"key": F.lit(0).cast("bigint"), "used": F.lit(0)}), 0)
    out = None
    # A pair of nodes that is too large goes down a block; its fingerprints may meet in several
    # node pairs there, each within the budget.
    for j in range(1, min(blocks, SPLITS + 1)):
        rows = common.stored(rows)
        large = common.stored(rows.groupBy("rot", "key").count().filter(F.col("count") > node_rows).select("rot", "key"))
        if large.isEmpty():
            break
        part = rows.join(large, ["rot", "key"], "left_anti").select("rot", "key", "fp0", "fp1")
        out = part if out is None else out.unionByName(part)
        # order matters here: the mask of a deeper block belongs to the pair, not to one side
        rows = spread(rows.join(large, ["rot", "key"], "left_semi"), j)
    # What is still too large is cut into chunks, and every two chunks meet under a key of their own.
    rows = common.stored(rows)
    large = rows.groupBy("rot", "key").count().filter(F.col("count") > node_rows)
    large = common.stored(large.select("rot", "key", F.ceil(F.col("count") / node_rows).cast("int").alias("chunks")))
    part = rows.select("rot", "key", "fp0", "fp1")
    if not large.isEmpty():
        own = F.pmod(F.xxhash64("fp0", "fp1"), F.col("chunks")).cast("int")
        cut = rows.join(large, ["rot", "key"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        cut = cut.select("rot", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"), "chunks").alias("key"), "fp0", "fp1")
        part = part.join(large, ["rot", "key"], "left_anti").unionByName(cut)
    out = part if out is None else out.unionByName(part)
    found = out.repartition(F.col("rot"), F.col("key")).sortWithinPartitions("rot", "key").mapInArrow(_linked(radius, blocks, confirm), "a0 bigint, a1 bigint, b0 bigint, b1 bigint")
    return common.stored(found.distinct())


# ------------------------------------------------------------------ components
def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, label)`` for every node of ``links (a, b)``; label: the smallest node reachable.

    Each round points every node to its smallest neighbour, follows the pointers to their roots by
    halving, and contracts the links to links between roots, which leaves few. A component's
    smallest node is always a root, so it is the last one. Tables are stored after each step; what
    goes to the driver is counts.
    """
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    links = common.stored(links.filter("a <> b").select(*pair("a", "b")).distinct())
    label = None
    for _ in range(rounds):
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("near")).unionAll(links.select("b", "a"))
        point = common.stored(ends.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("root")))
        while True:
            far = point.select(F.col("node").alias("root"), F.col("root").alias("far"))
            point = common.stored(point.join(far, "root").select("node", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")))
            moved = point.filter("moved").count()
            point = point.select("node", "root")
            if not moved:
                break
        if label is None:
            label = point.withColumnRenamed("root", "label")
        else:
            up = point.select(F.col("node").alias("label"), F.col("root").alias("up"))
            label = common.stored(label.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label")))
        root = lambda c: point.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        links = common.stored(links.join(root("a"), "a").join(root("b"), "b").filter("ra <> rb").select(*pair("ra", "rb")).distinct())
        if links.isEmpty():
            return label
    raise RuntimeError("components did not settle")


# ------------------------------------------------------------------ similarity
def similar_sets(sets: DataFrame, similarity: float) -> DataFrame:
    """``(node, label)`` for every node of ``sets (node, hashes)`` that is similar to another one:
    components over all pairs whose Jaccard similarity is ``similarity`` or more."""
    words = sets.select("node", F.size("hashes").alias("n"), F.explode("hashes").alias("word"))
    often = words.groupBy("word").agg(F.count("*").alias("uses")).filter("uses > 1")
    shared = words.join(often, "word").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("uses", "word"))).alias("words"))
    # the words of one set only are the rarest; the small number keeps rounding from losing a word
    take = F.expr(f"int(n - ceil({similarity}D * n - 1e-9D) + 1 - (n - size(words)))")
    rare = common.stored(shared.filter(take > 0).select("node", "n", F.explode(F.slice("words", 1, take)).alias("w")).select("node", "n", F.col("w.word").alias("word")))

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda s: sets.select(F.col("node").alias(s), F.col("hashes").alias(f"h{s}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        both = both.select("a", "b", F.size(F.array_intersect("ha", "hb")).alias("common"), (F.size("ha") + F.size("hb")).alias("total"))
        return common.stored(both.filter(F.expr(f"common >= {similarity}D * (total - common) - 1e-9D")).select("a", "b"))

    sized = F.expr(f"least(na, nb) >= {similarity}D * greatest(na, nb) - 1e-9D")
    tried = edges = label = None
    # Each round compares sets with two of those that have the same word, later ones with two that
    # differ from word to word; it ends when all that meet are together or nothing new is found.
    for again in range(STAR_ROUNDS):
        own = F.col("node") if not again else F.xxhash64("node", "word", F.lit(again))
        ends = rare.groupBy("word").agg(*(f(F.struct(own.alias("by"), "node", "n", *(["label"] if again else []))).alias(e) for f, e in ((F.min, "lo"), (F.max, "hi"))))
        met = rare.join(ends.filter("lo.node <> hi.node"), "word").withColumn("e", F.explode(F.array("lo", "hi"))).filter("label <> e.label" if again else "node <> e.node")
        met = met.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("e.node").alias("b"), F.col("e.n").alias("nb")).filter(sized)
        met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        met = common.stored(met if tried is None else met.join(tried, ["a", "b"], "left_anti"))
        tried = met if tried is None else tried.unionAll(met)
        found = verified(met)
        if again and found.isEmpty():
            break
        edges = found if edges is None else edges.unionAll(found)
        label = components(edges)
        rare = rare.select("node", "n", "word").join(label, "node", "left").select("node", "n", "word", F.coalesce("label", "node").alias("label"))
        apart = rare.groupBy("word").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("word")
        rare = common.stored(rare.join(apart, "word", "left_semi"))
    rare = rare.join(sets.select("node", "bits"), "node")
    one = lambda s: rare.select("word", *(F.col(c).alias(f"{c[0]}{s}") for c in ("n", "label", "bits")), F.col("node").alias(s))
    # parities tell most that differ too much apart before a pair of them is made; none that is similar is lost
    differ = sum((F.bit_count(F.get("ba", F.lit(i)).bitwiseXOR(F.get("bb", F.lit(i)))) for i in range(PARITIES)), F.lit(0))
    alike = differ <= F.expr(f"na + nb - 2 * ceil({similarity}D / (1 + {similarity}D) * (na + nb) - 1e-9D)")
    rest = one("a").join(one("b"), "word").filter("a < b and la <> lb").filter(sized).filter(alike).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("met"))
    # what two sets can share: the rare words that both have, and what comes after these in one of them
    most = F.expr(f"met + ceil({similarity}D * greatest(na, nb) - 1e-9D) - 1")
    rest = rest.filter(most >= F.expr(f"{similarity}D / (1 + {similarity}D) * (na + nb) - 1e-9D")).select("a", "b")
    more = verified(rest.join(tried, ["a", "b"], "left_anti"))
    return label if more.isEmpty() else components(edges.unionAll(more))


def similar_components(docs: DataFrame, fps: DataFrame, links: DataFrame, id_col: str, text_col: str, shingle: int, seed: int, similarity: float) -> DataFrame:
    """``fps`` with ``component_id``: sets of shingles at ``similarity`` or more are together, if the
    fingerprints of both have links or other sets."""
    names = ["fp0", "fp1"]
    sets = common.stored(fps.groupBy(*names, "set_key").agg(F.min("doc_id").alias("rep")))
    near = links.select(F.col("a0").alias("fp0"), F.col("a1").alias("fp1")).unionAll(links.select("b0", "b1"))
    near = near.unionAll(sets.groupBy(*names).count().filter("count > 1").select(*names)).distinct()
    reps = sets.groupBy("set_key").agg(F.min("rep").alias("rep"))
    drawn = sets.join(near, names, "left_semi").select("set_key").distinct()
    nodes = common.stored(reps.join(drawn, "set_key").select(F.col("rep").alias(id_col)))
    if nodes.count() <= GONE_ROWS:
        nodes = F.broadcast(nodes)
    label = similar_sets(common.stored(shingle_sets(docs.join(nodes, id_col, "left_semi"), id_col, text_col, shingle, seed)), similarity)
    reps = reps.join(label.select(F.col("node").alias("rep"), F.col("label").alias("component_id")), "rep", "left")
    return fps.join(reps.select("set_key", F.coalesce("component_id", "rep").alias("component_id")), "set_key").drop("set_key")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, blocks: int = 4, seed: int = 42, confirm: int | None = None, node_rows: int = NODE_ROWS, similarity: float | None = None) -> DataFrame:
    """``(doc_id, fp0[, fp1], component_id)``: a row for each row of ``docs``.

    ``confirm``: if given, a second fingerprint (seed + 1) is made, and a link also needs at most
    ``confirm`` differing bits in the 128 of both. ``similarity``: if given (with ``confirm``, and
    ids that are bigints, unique and not null), links are candidates, and what joins documents is
    the exact Jaccard similarity of their sets of shingles.
    """
    n_hashes = 1 if confirm is None else 2
    fps = common.stored(fingerprints(docs, id_col, text_col, shingle, seed, n_hashes, similarity is not None))
    names = [f"fp{k}" for k in range(n_hashes)]
    # one row per distinct fingerprint with the smallest document that has it
    classes = common.stored(fps.groupBy(*names).agg(F.min("doc_id").alias("rep")))
    found = trie_links(classes, radius, blocks, confirm, node_rows)
    if similarity is not None:
        return similar_components(docs, fps, found, id_col, text_col, shingle, seed, similarity)
    # nodes are fingerprints, so one that only rows without an id have still connects its neighbours
    node = lambda s: F.col(f"{s}0") if n_hashes == 1 else F.struct(*(F.col(f"{s}{k}").alias(f"f{k}") for k in range(n_hashes)))
    label = components(found.select(node("a").alias("a"), node("b").alias("b")))
    classes = classes.withColumnsRenamed({n: f"n{n[2:]}" for n in names}).withColumn("node", node("n")).join(label, "node", "left")
    classes = classes.select(*(F.col(f"n{n[2:]}").alias(n) for n in names), "rep", F.coalesce("label", "node").alias("label"))
    least = classes.groupBy("label").agg(F.min("rep").alias("component_id"))
    return fps.join(classes.join(least, "label").select(*names, "component_id"), names)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id.

    The rows are stored with their numbers: numbers made again by a later job may name other rows.
    """
    rows = common.stored(docs.withColumn("__row", F.monotonically_increasing_id()))
    found = near_duplicates(rows, "__row", text_col, **how).select(F.col("doc_id").alias("__row"), "component_id")
    ids = rows.select("__row", F.col(id_col).alias("__id"))
    first = found.join(ids, "__row").groupBy("component_id").agg(F.min(F.struct(F.col("__id").isNull(), "__id", "__row")).alias("first"))
    kept = first.select(F.col("first.__row").alias("__row"))
    gone = common.stored(ids.select("__row").join(kept, "__row", "left_anti"))
    if gone.count() <= GONE_ROWS:
        gone = F.broadcast(gone)
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)
