"""Benchmark decontamination by SimHash of item-sized windows.

Texts are lower-cased and cut into words (runs of letters, digits and underscores); shingles are
five words (an item with fewer words is one shingle of them all). For each document:

1. Windows with the length of an item, of every length that items have. A window is left out only if it
   has too few shingles of the benchmark to be similar to anything in it (counted by running sums).
2. A window is fingerprinted by SimHash over its shingles, repeats counted, from running sums of bits.
3. Multi-index of the items' fingerprints, one for each length: eight blocks of eight bits, and for each
   block and value the items whose block differs from it in at most two bits. Two fingerprints within
   ``RADIUS`` = 23 bits have such a block by the pigeonhole principle, so a window's eight lookups return
   every item within the radius; those further away go by their whole distance. At the similarity asked
   for, the chance that a similar window is further away is about one in a million.
4. Verification: exact weighted-shingle similarity, sum of minima by sum of maxima of counts.

The benchmark goes to the tasks in blocks of at most ``BLOCK_BYTES`` of text, kept by each Python
worker. A larger benchmark takes a pass over the documents for each block, and the passes' findings
are stored and put together by row.

Defined cases: null texts and items are empty and match nothing; repeated items are each reported,
repeated documents keep their rows; a document shorter than an item is one window; among equally
similar windows the first is reported; empty tables give empty results; other columns pass.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 23
BLOCKS = 8
BLOCK_BYTES = 8_000_000
WINDOWS_AT_ONCE = 2048
WORD = re.compile(r"\w+")
LEAK = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start_word", T.IntegerType()), T.StructField("end_word", T.IntegerType()), T.StructField("similarity", T.DoubleType())]))
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(words: list[str], k: int) -> list[tuple[str, ...]]:
    return [tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


def similarity(a: Counter, b: Counter) -> float:
    """Sum of the smaller counts by sum of the larger ones."""
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return both / (a.total() + b.total() - both) if a or b else 0.0


def _bits(parts: list[tuple[str, ...]]) -> np.ndarray:
    import xxhash

    h = np.fromiter((xxhash.xxh64_intdigest(" ".join(p).encode("utf-8", "surrogatepass")) for p in parts), "<u8", len(parts))
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _pack(ones: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fingerprints from how many of n hashes have each bit."""
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").ravel()


class MultiIndex:
    """Fingerprints by the values of their blocks."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        values = np.arange(256, dtype=np.uint8)
        own = prints.view(np.uint8).reshape(-1, BLOCKS)
        # for each block a row of bits for each value: the fingerprints that a lookup of it returns
        self.tables = [np.packbits(np.bitwise_count(values[:, None] ^ own[:, j]) <= RADIUS // BLOCKS, axis=1) for j in range(BLOCKS)]

    def lookup(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (in ``prints``, in the index) of all pairs within the radius."""
        own = np.ascontiguousarray(prints).view(np.uint8).reshape(-1, BLOCKS)
        found = self.tables[0][own[:, 0]]
        for j in range(1, BLOCKS):
            found = found | self.tables[j][own[:, j]]
        at, item = np.nonzero(np.unpackbits(found, axis=1, count=len(self.prints)))
        near = np.bitwise_count(prints[at] ^ self.prints[item]) <= RADIUS
        return at[near], item[near]


class Benchmark:
    """Items of a benchmark block: their shingles, and for each length an index of fingerprints."""

    def __init__(self, items: list[tuple[int, str | None]]):
        by_words: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for item_id, text in items:
            if w := words_of(text):
                by_words[tuple(w)].append(item_id)
        self.words = list(by_words)
        self.ids = [sorted(by_words[w], key=lambda x: (x is None, x)) for w in self.words]
        self.size = [min(SHINGLE, len(w)) for w in self.words]
        self.counts = [Counter(shingles(list(w), k)) for w, k in zip(self.words, self.size)]
        self.vocabulary = {x: i for i, x in enumerate(dict.fromkeys(x for w in self.words for x in w), 1)}
        known: dict[int, set[int]] = defaultdict(set)
        by_length: dict[int, list[int]] = defaultdict(list)
        for item, (w, k) in enumerate(zip(self.words, self.size)):
            known[k].update(self.hashes(np.array([self.vocabulary[x] for x in w], np.int64), k).tolist())
            by_length[len(w)].append(item)
        self.known = {k: np.array(sorted(h), np.uint64) for k, h in known.items()}
        prints = [_pack(_bits(p).sum(0, dtype=np.int64)[None], np.array([len(p)]))[0] for p in (shingles(list(w), k) for w, k in zip(self.words, self.size))]
        self.by_length = {n: (np.array(own), MultiIndex(np.array([prints[i] for i in own], np.uint64))) for n, own in sorted(by_length.items())}

    @staticmethod
    def hashes(ids: np.ndarray, k: int) -> np.ndarray:
        """A hash of each run of k word numbers."""
        n = max(0, len(ids) - k + 1)
        ids = ids.astype(np.uint64)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = (out ^ ids[j : j + n]) * MIX
        return out

    def _sums(self, ids: np.ndarray, k: int) -> np.ndarray:
        """Running sums of which shingles of k words are in the benchmark."""
        inside = np.zeros(max(0, len(ids) - k + 1), bool)
        zeros = np.concatenate(([0], np.cumsum(ids == 0)))
        at = np.flatnonzero(zeros[k:] == zeros[:-k]) if len(ids) >= k else np.empty(0, np.int64)
        if len(at):  # runs of k known words
            h = self.hashes(ids, k)[at]
            keys = self.known[k]
            inside[at] = keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h
        return np.concatenate(([0], np.cumsum(inside)))

    def leaks(self, text: str | None) -> list[dict]:
        words = words_of(text)
        ids = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words)) if words else np.empty(0, np.int64)
        if not ids.any():
            return []
        sums = {k: self._sums(ids, k) for k in self.known}
        best: dict[int, tuple[float, int, int]] = {}
        for n, (items, index) in self.by_length.items():
            k = min(SHINGLE, n)
            own = n - k + 1
            if sums[k][-1] < SIMILARITY * own - 1e-9:  # not even all together
                continue
            starts = np.arange(max(1, len(words) - n + 1))
            count = np.maximum(1, np.minimum(starts + n, len(words)) - starts - k + 1)
            held = sums[k][starts + count] - sums[k][starts]
            # what a window shares with an item is among its shingles that the benchmark has
            starts = starts[held >= SIMILARITY * (count + own - held) - 1e-9]
            if len(starts):
                self._search(words, n, k, starts, items, index, best)
        return [{"item_id": i, "start_word": s, "end_word": e, "similarity": v} for item, (v, s, e) in sorted(best.items()) for i in self.ids[item]]

    def _search(self, words: list[str], n: int, k: int, starts: np.ndarray, items: np.ndarray, index: MultiIndex, best: dict) -> None:
        """The best window of each of the items, which all have n words."""
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > 4 * n) + 1):
            for at in range(0, len(part), WINDOWS_AT_ONCE):
                s = part[at : at + WINDOWS_AT_ONCE]
                low, high = int(s[0]), min(len(words), int(s[-1]) + n)
                run = np.concatenate((np.zeros((1, 64), np.int64), np.cumsum(_bits(shingles(words[low:high], k)), axis=0, dtype=np.int64)))
                ends = np.minimum(s + n, len(words))
                count = np.maximum(1, ends - s - k + 1)
                windows, found = index.lookup(_pack(run[s - low + count] - run[s - low], count))
                for w, item in zip(windows.tolist(), items[found].tolist()):
                    start, end = int(s[w]), int(ends[w])
                    v = similarity(Counter(shingles(words[start:end], k)), self.counts[item])
                    if v >= SIMILARITY and (item not in best or (v, -start) > (best[item][0], -best[item][1])):
                        best[item] = (v, start, end)


@lru_cache(maxsize=1)
def _benchmark(items: tuple[tuple[int, str | None], ...]) -> Benchmark:
    return Benchmark(list(items))


def with_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", out_col: str = "leaks") -> DataFrame:
    """``docs`` with ``out_col``: array of (item_id, start_word, end_word, similarity), the best window
    of each item that the text holds."""
    common.bound_batches(docs.sparkSession)
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text_col).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_BYTES))
    docs = docs.select(*(c for c in docs.columns if c != out_col))
    # bounded: the rows of one block of the benchmark's text
    rows = lambda k: tuple((r.item_id, r.text) for r in items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).toLocalIterator())
    if blocks == 1:
        return _pass(docs, rows(0), text_col, out_col)
    numbered = common.stored(docs.withColumn("__row", F.monotonically_increasing_id()))
    texts = numbered.select("__row", F.col(text_col).alias("text"))
    found = [common.stored(_pass(texts, rows(k), "text", "found").filter(F.size("found") > 0).select("__row", "found")) for k in range(blocks)]
    found = reduce(DataFrame.unionAll, found).groupBy("__row").agg(F.flatten(F.collect_list("found")).alias(out_col))
    return numbered.join(found, "__row", "left").select(*docs.columns, F.coalesce(out_col, F.array().cast(LEAK)).alias(out_col))


def _pass(docs: DataFrame, items: tuple[tuple[int, str | None], ...], text_col: str, out_col: str) -> DataFrame:
    cols = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(items)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = _benchmark(shared.value)
        for b in common.slices(batches):
            found = [bench.leaks(t) for t in b.column(cols.index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*cols, out_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out_col, LEAK)]))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, start_word, end_word, similarity)``: a row for each item in each document."""
    rows = with_leaks(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark)
    return rows.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.start_word", "leak.end_word", F.round("leak.similarity", 6).alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark."""
    rows = docs.select(F.struct("*").alias("__doc"), F.col(text_col).alias("text"))
    return with_leaks(rows, benchmark).filter(F.size("leaks") == 0).select("__doc.*")
