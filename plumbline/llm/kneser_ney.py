"""Quality classifier: interpolated modified Kneser-Ney n-gram model of trusted text.

The units are characters, all of Unicode as they are (``ORDER`` = 5): the model has every n-gram
of the trusted text and grows with it. Word n-grams were left out: hardly any repeats inside a
document, so joining them moves several times the input.

Model: n-gram counts of all trusted documents but the held-out tenth, gathered per task and summed
over shards of (language, n-gram); continuation counts, discounts from counts of counts, context
totals and discounted shares by joins of the sharded counts on (language, context).

Scoring, by joins with the sharded model: documents of one language are packed and dealt to blocks
of about ``BLOCK_BYTES``; each block asks for its distinct n-grams once, the questions are joined
with the model on (language, n-gram), and the answers go back to the block, where each document's
perplexity is computed. So what is shuffled is a block's distinct n-grams, not each document's.
Packs are Arrow streams of whole rows, compressed; documents move once.

Verdict: the bits per character, with ``PRIOR_CHARS`` characters at the language's mean (short
texts say little), must not exceed the language's quantile over held-out trusted documents by more
than the factor ``SLACK`` in perplexity.

Languages with fewer than ``LEAST_DOCS`` trusted documents (or none held out), and null, use the
model of all trusted text together. Defined cases: null text is the empty text; a text without
characters is rejected with null perplexity; without any trusted document everything is kept; null
ids are never trusted; repeated rows keep their rows; empty tables give empty results; other
columns pass unchanged, but for one that has the name of the result column, which is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

ORDER = 5
#: Stands before a text as often as an n-gram needs it; a code point that is no character.
START = "\U0010ffff"
ALL = "*"
LEAST_DOCS = 20
HELD_OUT = 10
QUANTILE = 0.99
SLACK = 1.2
PRIOR_CHARS = 32
#: Parts of a bit in which quantiles are counted.
STEPS = 256
#: Bytes of text in a block, and in the packs that are dealt to blocks.
BLOCK_BYTES = 20_000_000
PACK_BYTES = 1_000_000
#: Characters looked at together, and n-grams that a task holds before it hands on their counts.
CHARS_AT_ONCE = 200_000
GRAMS_AT_ONCE = 500_000
LANGUAGE_ROWS = 100_000
#: Questions of a batch.
GRAMS_A_BATCH = 100_000
MIX = np.uint64(0x9E3779B97F4A7C15)


# ------------------------------------------------------------------ n-grams of texts
def pieces(texts: list[str], order: int) -> Iterator[list[tuple[int, str]]]:
    """Groups of (document, piece) of about ``CHARS_AT_ONCE``; a piece starts with the ``order - 1``
    characters before it, so that each character of a text ends exactly one n-gram of one piece."""
    held, size, before = [], 0, START * (order - 1)
    for doc, text in enumerate(texts):
        for at in range(0, len(text), CHARS_AT_ONCE):
            head = before if not at else text[at - order + 1 : at]
            held.append((doc, head + text[at : at + CHARS_AT_ONCE]))
            size += len(held[-1][1])
            if size >= CHARS_AT_ONCE:
                yield held
                held, size = [], 0
    if held:
        yield held


def windows(group: list[tuple[int, str]], order: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct n-grams, which of them ends at each character, the character's document)."""
    joined = "".join(piece for _, piece in group)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    key = np.zeros(len(points) - order + 1, np.uint64)
    for j in range(order):
        key = (key ^ points[j : j + len(key)]) * MIX
        key ^= key >> np.uint64(29)
    sizes = np.array([len(piece) for _, piece in group])
    chars = sizes - order + 1  # n-grams that lie inside the piece
    starts = np.cumsum(sizes) - sizes
    at = np.repeat(starts - (np.cumsum(chars) - chars), chars) + np.arange(int(chars.sum()))
    which, _ = pd.factorize(key[at])
    first = np.flatnonzero(np.diff(np.maximum.accumulate(which), prepend=-1))
    return [joined[p : p + order] for p in at[first].tolist()], which, np.repeat([doc for doc, _ in group], chars)


# ------------------------------------------------------------------ counts
def trusted_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``(lang, text, held)`` of the trusted documents: quality 1 and not toxic."""
    ids = labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").alias("__id")).distinct()
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(lang_col), F.lit(ALL)).alias("lang"), common.text_or_empty(text_col).alias("text"))
    rows = rows.join(common.broadcast_if_few(ids), "__id", "left_semi").filter("text <> ''")
    return rows.select("lang", "text", (F.pmod(F.xxhash64("__id"), F.lit(HELD_OUT)) == 0).alias("held"))


def counts(trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """``(lang, gram, c)``: counts of all n-grams of ``order`` characters of the rows ``(lang, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # held as Arrow tables: counters of Python strings are some ten times their size
        held: dict[str, list[pa.Table]] = {}
        fresh = 0

        def merged(lang: str) -> pa.Table:
            sums = pa.concat_tables(held[lang]).group_by("gram", use_threads=False).aggregate([("c", "sum")])
            held[lang] = [pa.table([sums["gram"], sums["c_sum"]], names=["gram", "c"])]
            return held[lang][0]

        def rows() -> Iterator[pa.RecordBatch]:
            for lang in list(held):
                for part in merged(lang).sort_by("gram").to_batches(GRAMS_A_BATCH):
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), part.num_rows), part["gram"], part["c"]], names=["lang", "gram", "c"])
            held.clear()

        for b in common.slices(batches):
            by: dict[str, list[str]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for group in pieces(texts, order):
                    grams, which, _ = windows(group, order)
                    held.setdefault(lang, []).append(pa.table([pa.array(grams, pa.string()), pa.array(np.bincount(which, minlength=len(grams)))], names=["gram", "c"]))
                    fresh += len(grams)
                    if fresh > GRAMS_AT_ONCE:
                        fresh = 0
                        if sum(merged(x).num_rows for x in list(held)) > GRAMS_AT_ONCE:
                            yield from rows()
        yield from rows()
        common.release()

    found = trusted.select("lang", "text").mapInArrow(run, "lang string, gram string, c bigint")
    return found.groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def with_pooled(counts_: DataFrame, fitted: DataFrame) -> DataFrame:
    """Counts of the languages in ``fitted`` and, as language ``ALL``, of all text together."""
    own = counts_.filter(F.col("lang") != ALL).join(common.broadcast_if_few(fitted.select("lang"), LANGUAGE_ROWS), "lang", "left_semi")
    pooled = counts_.groupBy("gram").agg(F.sum("c").alias("c")).select(F.lit(ALL).alias("lang"), "gram", "c")
    return own.unionByName(pooled)


# ------------------------------------------------------------------ model
def model(top: DataFrame, order: int = ORDER) -> DataFrame:
    """``(lang, gram, p, g)`` for n-grams of 0 to ``order`` characters.

    The probability of an n-gram's last character is its own discounted share p (none: 0) plus the
    weight g of the characters before (none: 1) times the probability without the first of them;
    that of no characters at all is p of the empty n-gram: 1 by the number of characters and one.
    """
    by_order = {order: common.stored(top)}
    for o in range(order - 1, 0, -1):  # continuation counts: how many characters stand before
        lower = by_order[o + 1].groupBy("lang", F.substring("gram", 2, o).alias("gram")).agg(F.count("*").alias("c"))
        by_order[o] = common.stored(lower)
    seen = reduce(DataFrame.unionByName, [rows.select("lang", F.lit(o).alias("ord"), "gram", F.substring("gram", 1, o - 1).alias("context"), "c") for o, rows in by_order.items()])
    few = seen.groupBy("lang", "ord").agg(*(F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    usual = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
    # a discount that is not above zero would leave unseen n-grams nothing
    formula = lambda i: i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")
    amount = lambda i: F.when(usual, F.when(formula(i) > 0, formula(i))).alias(f"d{i}")
    few = few.select("lang", "ord", amount(1), amount(2), amount(3)).fillna({f"d{i}": i / 2 for i in (1, 2, 3)})
    few = common.broadcast_if_few(common.stored(few))
    contexts = seen.groupBy("lang", "ord", "context").agg(F.sum("c").alias("total"), *(F.count_if(F.col("c") == i if i < 3 else F.col("c") >= 3).alias(f"m{i}") for i in (1, 2, 3)))
    contexts = contexts.join(few, ["lang", "ord"])
    minus = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    none = F.lit(None).cast("double")
    shares = seen.join(contexts, ["lang", "ord", "context"]).select("lang", "gram", ((F.col("c") - minus) / F.col("total")).alias("p"), none.alias("g"))
    weights = contexts.select("lang", F.col("context").alias("gram"), none.alias("p"), (sum(F.col(f"d{i}") * F.col(f"m{i}") for i in (1, 2, 3)) / F.col("total")).alias("g"))
    empty = by_order[1].groupBy("lang").agg((1 / (F.count("*") + 1)).alias("p")).select("lang", F.lit("").alias("gram"), "p", none.alias("g"))
    rows = shares.unionByName(weights).unionByName(empty)
    out = common.stored(rows.groupBy("lang", "gram").agg(F.max("p").alias("p"), F.max("g").alias("g")))
    for counted in by_order.values():
        common.discard(counted)
    return out


def distinct(parts: list[pa.Array]) -> pa.Array:
    return pc.unique(pa.chunked_array(parts, pa.string()))


def closed(grams: pa.Array, order: int) -> Iterator[pa.Array]:
    """The distinct n-grams of ``order`` characters with all that their probabilities ask for: suffixes, and what
    comes before the last character of each; shorter ones follow, each once, the empty one last."""
    level, before = grams, pa.array([], pa.string())
    for n in range(order, 0, -1):
        yield distinct([level, before])
        before = pc.utf8_slice_codeunits(level, 0, n - 1)
        level = distinct([pc.utf8_slice_codeunits(level, 1, n)])
    yield pa.array([""], pa.string())


class Answers:
    """Probabilities from the rows of the model that a block asked for, as Arrow arrays by length."""

    def __init__(self, rows: pa.Table, order: int):
        rows = rows.select(["gram", "p", "g"]).combine_chunks()
        length = pc.utf8_length(rows["gram"])
        self.order, self.by_length = order, []
        for n in range(order + 1):
            part = rows.filter(pc.equal(length, n)).combine_chunks()
            gram = part["gram"].combine_chunks() if part.num_rows else pa.array([], pa.string())
            self.by_length.append((gram, part["p"].to_numpy(), part["g"].to_numpy()))

    def values(self, grams: pa.Array, n: int, which: int, none: float) -> np.ndarray:
        """p (1) or g (2) of n-grams of n characters; ``none`` for those without."""
        known, own = self.by_length[n][0], self.by_length[n][which]
        if not len(known):
            return np.full(len(grams), none)
        at = pc.fill_null(pc.index_in(grams, known), -1).to_numpy()
        found = np.where(at < 0, np.nan, own[at])
        return np.where(np.isnan(found), none, found)

    def probabilities(self, grams: list[str]) -> np.ndarray:
        """Of the last character of each n-gram of ``order`` characters after those before it."""
        whole, empty = pa.array(grams, pa.string()), self.by_length[0][1]
        p = np.full(len(grams), empty[0] if len(empty) else 1.0)
        for n in range(1, self.order + 1):
            suffix = pc.utf8_slice_codeunits(whole, self.order - n, self.order)
            before = pc.utf8_slice_codeunits(whole, self.order - n, self.order - 1)
            p = self.values(suffix, n, 1, 0.0) + self.values(before, n - 1, 2, 1.0) * p
        return p

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(characters, bits) of each text."""
        bits = np.zeros(len(texts))
        for group in pieces(texts, self.order):
            grams, which, doc = windows(group, self.order)
            bits += np.bincount(doc, weights=-np.log2(self.probabilities(grams))[which], minlength=len(texts))
        return np.array([len(t) for t in texts], np.int64), bits


# ------------------------------------------------------------------ scoring
def packed(rows: DataFrame, carried: int) -> DataFrame:
    """``(own, block, pack)`` from rows whose last two columns are the language of the model and its
    number of blocks, and whose first ``carried`` ones are packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        held: dict[str, list[pa.RecordBatch]] = {}
        size, blocks = Counter(), {}

        def pack(own: str) -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[own][0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(pa.Table.from_batches(held.pop(own)).combine_chunks())
            body = sink.getvalue().to_pybytes()
            del size[own]
            # the pack's content decides its block, so packs made anew go to the same one
            return pa.RecordBatch.from_arrays([pa.array([own]), pa.array([xxhash.xxh64_intdigest(body) % blocks[own]], pa.int64()), pa.array([body], pa.binary())], names=["own", "block", "pack"])

        for b in common.slices(batches):
            own = b.column(carried).to_pylist()
            for lang in dict.fromkeys(own):
                at = [i for i, x in enumerate(own) if x == lang]
                part = b.select(range(carried)).take(pa.array(at))
                blocks[lang] = b.column(carried + 1)[at[0]].as_py()
                held.setdefault(lang, []).append(part)
                size[lang] += part.nbytes
                if size[lang] >= PACK_BYTES:
                    yield pack(lang)
            if size.total() > 32 * PACK_BYTES:
                yield pack(max(size, key=size.get))
        for lang in list(held):
            yield pack(lang)

    return rows.mapInArrow(run, "own string, block bigint, pack binary")


def unpacked(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all()


def questions(packs: DataFrame, text_at: int, order: int) -> DataFrame:
    """``(own, block, gram)``: what each block asks the model, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # held as Arrow arrays: a set of Python strings is some ten times their size
        block, grams, fresh = None, [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            if block is not None:
                for asked in closed(distinct(grams), order):
                    for at in range(0, len(asked), GRAMS_A_BATCH):
                        part = asked.slice(at, GRAMS_A_BATCH)
                        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(block[0], pa.string()), len(part)), pa.repeat(pa.scalar(block[1], pa.int64()), len(part)), part], names=["own", "block", "gram"])
                grams.clear()

        for b in batches:  # sorted by block
            for own, number, body in zip(*(c for c in b.columns)):
                if (own.as_py(), number.as_py()) != block:
                    yield from rows()
                    block, fresh = (own.as_py(), number.as_py()), 0
                texts = [t or "" for t in unpacked(body.as_py()).column(text_at).to_pylist()]
                for group in pieces(texts, order):
                    grams.append(pa.array(windows(group, order)[0], pa.string()))
                    fresh += len(grams[-1])
                    if fresh > GRAMS_AT_ONCE:
                        grams[:], fresh = [distinct(grams)], 0
        yield from rows()
        common.release()

    return packs.sortWithinPartitions("own", "block").mapInArrow(run, "own string, block bigint, gram string")


def scored(docs: DataFrame, model_: DataFrame, languages: DataFrame, lang_col: str, text_col: str, order: int = ORDER) -> DataFrame:
    """``docs`` with the columns ``__own`` (language of the model), ``__chars`` and ``__bits``.

    languages: ``(lang, own)``; a language that isn't there uses the model of all text.
    """
    cols, text_at = docs.columns, docs.columns.index(text_col)
    lang = F.coalesce(F.col(lang_col), F.lit(ALL))
    sizes = docs.groupBy(lang.alias("lang")).agg(F.sum(F.octet_length(F.coalesce(text_col, F.lit("")))).alias("bytes"))
    sizes = sizes.join(common.broadcast_if_few(languages, LANGUAGE_ROWS), "lang", "left").select("lang", F.coalesce("own", F.lit(ALL)).alias("own"), "bytes")
    sizes = sizes.select(F.col("lang").alias("__lang"), F.col("own").alias("__own"), F.ceil(F.sum("bytes").over(W.partitionBy("own")) / BLOCK_BYTES + F.lit(0.5)).cast("bigint").alias("__blocks"))
    sizes = common.stored(sizes)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), sizes.select("__own", "__blocks").distinct().agg(F.coalesce(F.sum("__blocks"), F.lit(0))).first()[0])
    rows = docs.withColumn("__lang", lang).join(common.broadcast_if_few(sizes, LANGUAGE_ROWS), "__lang").select(*cols, "__own", "__blocks")
    # both branches below read one exchange: the documents are shuffled once
    packs = packed(rows, len(cols)).repartition(min(parts, 20_000), "own", "block")
    answers = questions(packs, text_at, order).join(model_.withColumnRenamed("lang", "own"), ["own", "gram"]).select("own", "block", "gram", "p", "g")
    schema = T.StructType([*docs.schema.fields, T.StructField("__own", T.StringType()), T.StructField("__chars", T.LongType()), T.StructField("__bits", T.DoubleType())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        got = Answers(right, order)
        out = []
        for own, body in zip(left.column("own").to_pylist(), left.column("pack")):
            rows = unpacked(body.as_py())
            chars, bits = got.score([t or "" for t in rows.column(text_at).to_pylist()])
            out.append(pa.table([*rows.columns, pa.array([own] * len(chars), pa.string()), pa.array(chars), pa.array(bits)], names=schema.names))
        common.release()
        return pa.concat_tables(out) if out else pa.Table.from_batches([], pa.schema([]))

    keys = ["own", "block"]
    return packs.groupBy(*keys).cogroup(answers.groupBy(*keys)).applyInArrow(score, schema)


class Classifier:
    """The fitted model and the limits of each language."""

    def __init__(self, docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, order: int = ORDER):
        common.bound_batches(docs.sparkSession)
        self.order = order
        trusted = trusted_rows(docs, labels)
        gathered = common.stored(counts(trusted.filter("not held"), order))
        self.fitted = not gathered.isEmpty()
        if not self.fitted:
            return
        known = trusted.groupBy("lang").agg(F.count_if(~F.col("held")).alias("docs"), F.count_if("held").alias("held"))
        known = known.filter((F.col("docs") >= LEAST_DOCS) & (F.col("held") > 0)).select("lang", F.col("lang").alias("own"))
        self.languages = common.stored(known)
        self.model = model(with_pooled(gathered, self.languages), order)
        common.discard(gathered)
        self.limits = self._limits(trusted.filter("held").select("lang", "text"), quantile, slack)

    def _limits(self, held: DataFrame, quantile: float, slack: float) -> DataFrame:
        """``(__own, mean, most)``: mean and most bits per character, from held-out trusted documents."""
        pooled = held.withColumn("lang", F.lit(ALL))
        rows = held.filter(F.col("lang") != ALL).join(common.broadcast_if_few(self.languages.select("lang"), LANGUAGE_ROWS), "lang", "left_semi").unionByName(pooled)
        rows = common.stored(scored(rows, self.model, self.languages, "lang", "text", self.order).select("__own", "__chars", "__bits"))
        mean = rows.groupBy("__own").agg((F.sum("__bits") / F.sum("__chars")).alias("mean"))
        steps = rows.join(common.broadcast_if_few(mean, LANGUAGE_ROWS), "__own").groupBy("__own", "mean", F.floor(_rate(F.col("mean")) * STEPS).alias("step")).agg(F.count("*").alias("n"))
        own = W.partitionBy("__own")
        upto = F.sum("n").over(own.orderBy("step")) / F.sum("n").over(own)
        reached = steps.withColumn("upto", upto).filter(F.col("upto") >= quantile).groupBy("__own", "mean").agg(F.min("step").alias("step"))
        return common.stored(reached.select("__own", "mean", ((F.col("step") + 1) / STEPS + F.log2(F.lit(slack))).alias("most")))

    def judged(self, docs: DataFrame, lang_col: str = "lang", text_col: str = "text", out_col: str = "quality") -> DataFrame:
        """``docs`` with ``out_col``: struct of perplexity, threshold, kept."""
        docs = docs.select(*(c for c in docs.columns if c != out_col))
        verdict = lambda perplexity, threshold, kept: F.struct(perplexity.alias("perplexity"), threshold.alias("threshold"), kept.alias("kept")).alias(out_col)
        none = F.lit(None).cast("double")
        if not self.fitted:
            return docs.select("*", verdict(none, none, F.lit(True)))
        rows = scored(docs, self.model, self.languages, lang_col, text_col, self.order)
        rows = rows.join(common.broadcast_if_few(self.limits, LANGUAGE_ROWS), "__own", "left")
        kept = (F.col("__chars") > 0) & (F.coalesce(_rate(F.col("mean")) <= F.col("most"), F.lit(True)))
        perplexity = F.when(F.col("__chars") > 0, F.pow(F.lit(2.0), F.col("__bits") / F.col("__chars")))
        return rows.select(*docs.columns, verdict(perplexity, F.pow(F.lit(2.0), F.col("most")), kept))

    def kept(self, docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
        """The rows of ``docs`` that are kept, with their columns."""
        return self.judged(docs, lang_col, text_col, "__quality").filter("__quality.kept").drop("__quality")


def _rate(mean):
    """Bits per character with some characters at the mean."""
    return (F.col("__bits") + PRIOR_CHARS * mean) / (F.col("__chars") + PRIOR_CHARS)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, lang, perplexity, threshold, kept)``: a row for each row of ``docs``."""
    rows = Classifier(docs, labels).judged(docs.select("doc_id", "lang", "text"))
    return rows.select("doc_id", "lang", F.round("quality.perplexity", 4).alias("perplexity"), F.round("quality.threshold", 4).alias("threshold"), "quality.kept")
