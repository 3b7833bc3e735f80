"""Hard negatives of an embedding table: rows of another label that score close below a positive.

Scores are integer inner products of vectors whose components are ``floor(SCALE * x)``. Most are never
computed: each vector is cut into 1, 4 and 16 segments, and of every segment mean and deviation are
stored with the row. The inner product of two segments of n components lies within n times the product
of the means, plus or minus n times the product of the deviations, so the sums bound the score. Pairs
whose bounds can't reach what an anchor still needs are dropped, the others go to the next, finer level;
what is left after the last is scored exactly, in integers.

Anchors (a stated query set) go through in blocks of ``BLOCK``; a block and what it needs are sent to
all tasks, which then read every row of the stored table once for the positives and once for the
negatives. A task keeps the best few rows of each anchor and hands on only these; a window over them
gives the result. No pair of all rows is made, no vector is shuffled, and neither label nor copies
make a hot group: rows stay where they lie.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component take no
part; a missing component of a shorter vector is 0; an anchor's own id is never its positive; repeated
rows are rows of their own, and a repeated anchor is mined as often as it is there; with fewer
candidates than wanted, all are returned; a positive with a negative score has no negatives (its band is
empty); scores must fit a long; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SCALE = 256
#: Segments of a vector on each level.
LEVELS = (1, 4, 16)
#: Anchors that are sent to the tasks together, and rows that a task looks at together.
BLOCK = 4096
ROWS = 1024
#: Wanted rows by anchor and by positive, and the band of negative scores in hundredths of the positive's.
POSITIVES = 5
NEGATIVES = 10
BAND = (30, 90)
LEAST = np.iinfo(np.int64).min
PREPARED = "vec_id bigint, label bigint, q array<bigint>, mean array<double>, deviation array<double>"


def edges(dims: int, segments: int) -> np.ndarray:
    """Where the segments of a vector begin and end."""
    return np.arange(segments + 1) * dims // segments


def summaries(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every segment, level after level, a row for each vector."""
    means, deviations = [], []
    for segments in LEVELS:
        at = edges(q.shape[1], segments)
        for a, b in zip(at[:-1], at[1:]):
            part = q[:, a:b].astype(np.float64)
            means.append(part.mean(axis=1) if b > a else np.zeros(len(q)))
            deviations.append(part.std(axis=1) if b > a else np.zeros(len(q)))
    return np.column_stack(means), np.column_stack(deviations)


class Vectors:
    """Rows with their labels, vectors and summaries, all of one width."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, mean: np.ndarray, deviation: np.ndarray):
        self.ids, self.labels, self.q, self.mean, self.deviation = ids, labels, q, mean, deviation
        # inner products below 2 to the 53rd are exact in floating point, where they are fastest
        self.largest = float(np.abs(q).max(initial=0))
        self.real = q.astype(np.float64)

    def __len__(self) -> int:
        return len(self.ids)

    def of(self, rows: np.ndarray) -> "Vectors":
        return Vectors(self.ids[rows], self.labels[rows], self.q[rows], self.mean[rows], self.deviation[rows])


def widened(q: np.ndarray, dims: int) -> np.ndarray:
    return q if q.shape[1] == dims else np.pad(q, ((0, 0), (0, dims - q.shape[1])))


def read(batch: pa.RecordBatch) -> Vectors:
    """A batch of the stored table; its vectors have one width."""
    q = batch["q"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    mean = batch["mean"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    deviation = batch["deviation"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return Vectors(batch["vec_id"].to_numpy(zero_copy_only=False), batch["label"].to_numpy(zero_copy_only=False), q, mean, deviation)


def scored(rows: Vectors, anchors: Vectors, r: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Exact scores of pairs of places."""
    real = rows.largest * anchors.largest * max(rows.q.shape[1], 1) < 2**53
    if len(r) * 4 > len(rows) * len(anchors) and real:
        return (rows.real @ anchors.real.T)[r, a].astype(np.int64)
    out = np.empty(len(r), np.int64)
    for at in range(0, len(r), 1 << 16):
        part = slice(at, at + (1 << 16))
        left, right = (rows.real, anchors.real) if real else (rows.q, anchors.q)
        out[part] = np.einsum("ij,ij->i", left[r[part]], right[a[part]])
    return out


def survivors(rows: Vectors, anchors: Vectors, least: np.ndarray, most: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, anchor) that are allowed and whose score may lie between the anchor's ``least`` and ``most``."""
    left, at = allowed, 0
    dims = rows.q.shape[1]
    slack = 1e-9 * (rows.largest * anchors.largest * max(dims, 1) + 1)
    for segments in LEVELS:
        size = np.diff(edges(dims, segments)).astype(np.float64)
        part = slice(at, at + segments)
        at += segments
        if not left.any():
            break
        middle = (rows.mean[:, part] * size) @ anchors.mean[:, part].T
        reach = (rows.deviation[:, part] * size) @ anchors.deviation[:, part].T + slack
        left = left & (middle + reach >= least) & (middle - reach <= most)
    return np.nonzero(left)


class Best:
    """The first ``k`` rows (highest score, then smallest id) of each of many targets."""

    def __init__(self, targets: int, k: int):
        self.k, self.n = k, targets
        self.target, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.needed = np.full(targets, LEAST, np.int64)

    def add(self, target: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(target):
            return
        t, s, i = np.concatenate([self.target, target]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((i, ~s, t))
        t, s, i = t[order], s[order], i[order]
        place = np.arange(len(t)) - np.searchsorted(t, t)
        kept = place < self.k
        self.target, self.score, self.id = t[kept], s[kept], i[kept]
        full = place[kept] == self.k - 1
        self.needed[self.target[full]] = self.score[full]

    def batches(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.target), 100_000):
            part = slice(at, at + 100_000)
            yield pa.record_batch({"target": pa.array(self.target[part]), "score": pa.array(self.score[part]), "vec_id": pa.array(self.id[part])})


def prepared(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """The rows that take part as ``PREPARED``: integer vectors with the summaries of their segments."""
    spark = rows.sparkSession
    common.bound_batches(spark)
    few = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    few = few.dropna()

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, ROWS):
            lengths = b["v"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = b["v"].flatten()
            values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lengths)), lengths)
            bad = np.bincount(row[~np.isfinite(values)], minlength=len(lengths)) > 0
            starts = np.concatenate([[0], np.cumsum(lengths)])
            for dims in np.unique(lengths[~bad]):
                mine = np.flatnonzero(~bad & (lengths == dims))
                q = np.floor(scale * values[starts[mine][:, None] + np.arange(dims)]).astype(np.int64)
                mean, deviation = summaries(q)
                yield pa.record_batch({
                    "vec_id": b["vec_id"].take(pa.array(mine)),
                    "label": b["label"].take(pa.array(mine)),
                    "q": pa.array(list(q), pa.list_(pa.int64())),
                    "mean": pa.array(list(mean), pa.list_(pa.float64())),
                    "deviation": pa.array(list(deviation), pa.list_(pa.float64())),
                })

    return few.mapInArrow(stored, PREPARED)


def uniform(batches: Iterator[pa.RecordBatch], anchors: Vectors) -> Iterator[tuple[Vectors, Vectors]]:
    """Rows of the stored table and the anchors, brought to one width."""
    for b in common.slices(batches, ROWS):
        lengths = b["q"].value_lengths().to_numpy(zero_copy_only=False)
        for dims in np.unique(lengths):
            rows = read(b.filter(pa.array(lengths == dims)))
            if dims == anchors.q.shape[1]:
                yield rows, anchors
                continue
            wide = max(dims, anchors.q.shape[1])
            yield tuple(Vectors(v.ids, v.labels, (q := widened(v.q, wide)), *summaries(q)) for v in (rows, anchors))


def _positives(batches: Iterator[pa.RecordBatch], anchors: Vectors, k: int) -> Iterator[pa.RecordBatch]:
    best = Best(len(anchors), k)
    for rows, wide in uniform(batches, anchors):
        for label in np.intersect1d(rows.labels, wide.labels):
            mine, its = rows.of(np.flatnonzero(rows.labels == label)), np.flatnonzero(wide.labels == label)
            few = wide.of(its)
            least = best.needed[its].astype(np.float64)
            r, a = survivors(mine, few, least, np.full(len(its), np.inf), mine.ids[:, None] != few.ids)
            s = scored(mine, few, r, a)
            good = s >= best.needed[its[a]]
            best.add(its[a[good]], s[good], mine.ids[r[good]])
    yield from best.batches()


def _negatives(batches: Iterator[pa.RecordBatch], anchors: Vectors, owner: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """``owner``: the anchor of each target; ``low`` and ``high``: its band."""
    best = Best(len(owner), k)
    for rows, wide in uniform(batches, anchors):
        need = np.maximum(low, best.needed).astype(np.float64)
        need[need > high] = np.inf
        least, most = np.full(len(wide), np.inf), np.full(len(wide), -np.inf)
        np.minimum.at(least, owner, need)
        np.maximum.at(most, owner, high.astype(np.float64))
        r, a = survivors(rows, wide, least, most, rows.labels[:, None] != wide.labels)
        s = scored(rows, wide, r, a)
        for turn in _turns(owner, len(wide)):
            t = turn[a]
            good = t >= 0
            good[good] = (s[good] >= np.maximum(low, best.needed)[t[good]]) & (s[good] <= high[t[good]])
            best.add(t[good], s[good], rows.ids[r[good]])
    yield from best.batches()


def _turns(owner: np.ndarray, anchors: int) -> list[np.ndarray]:
    """First, second ... target of each anchor (-1: none); targets of an anchor stand together."""
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    out = []
    for k in range(place.max(initial=-1) + 1):
        turn = np.full(anchors, -1, np.int64)
        turn[owner[place == k]] = np.flatnonzero(place == k)
        out.append(turn)
    return out


def first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each target over all tasks."""
    order = Window.partitionBy("target").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: str = "vec_id % 100 = 0", positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = BAND, block: int = BLOCK, **cols: str) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``; ``anchor``: an
    expression on ``vec_id`` and ``label`` that chooses the anchors."""
    spark = rows.sparkSession
    table = common.stored(prepared(rows, **cols))
    chosen = table.filter(F.expr(anchor))
    blocks = -(-chosen.count() // block)
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not blocks:
        return spark.createDataFrame([], out)
    if blocks > 1:
        chosen = common.stored(chosen.repartition(blocks).withColumn("block", F.spark_partition_id()))
    parts = []
    for n in range(blocks):
        its = chosen.filter(F.col("block") == n) if blocks > 1 else chosen
        arrow = its.select("vec_id", "label", "q", "mean", "deviation").toArrow().combine_chunks()
        if not arrow.num_rows:
            continue
        anchors = together(arrow)
        sent = spark.sparkContext.broadcast(anchors)
        found = table.mapInArrow(lambda b, sent=sent: _positives(b, sent.value, positives), "target bigint, score bigint, vec_id bigint")
        got = first(found, positives).toArrow().sort_by([("target", "ascending"), ("rank", "ascending")])
        owner, score, ids = (got[c].to_numpy() for c in ("target", "score", "vec_id"))
        low, high = -((-band[0] * score) // 100), band[1] * score // 100
        bands = spark.sparkContext.broadcast((owner, low, high))
        found = table.mapInArrow(lambda b, sent=sent, bands=bands: _negatives(b, sent.value, *bands.value, negatives), "target bigint, score bigint, vec_id bigint")
        # as many rows as the block has positives
        named = spark.createDataFrame(pa.table({"target": np.arange(len(owner)), "anchor_id": anchors.ids[owner], "positive_id": ids, "positive_score": score}))
        part = first(found, negatives).join(F.broadcast(named), "target")
        parts.append(part.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
        if blocks > 1:
            parts[-1] = common.stored(parts[-1])
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def together(arrow: pa.Table) -> Vectors:
    """Anchors of a block, brought to one width."""
    vectors = [np.array(x, np.int64) for x in arrow["q"].to_pylist()]
    dims = max(map(len, vectors))
    q = np.stack([np.pad(v, (0, dims - len(v))) for v in vectors]) if dims else np.zeros((len(vectors), 0), np.int64)
    order = np.argsort(arrow["vec_id"].to_numpy(), kind="stable")
    return Vectors(arrow["vec_id"].to_numpy()[order], arrow["label"].to_numpy()[order], q[order], *summaries(q[order]))


def relabelled(rows: DataFrame) -> DataFrame:
    """The contract's labels: where the id is divisible by 7, label becomes (label + 1) % 10."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label")))
