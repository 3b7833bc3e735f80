"""Language identification in two levels: the family first, then linear support vector machines
between each two languages of that family.

Features of a text are its letters, pairs and triples of letters (lower case; whatever is no letter
or mark is a space, runs of spaces are one), dealt to ``DIMS`` buckets by a fixed hash. Texts are
taken whole, in slices of bounded size whose counts add up.

* Family: multinomial naive Bayes over the bucket counts of *all* training documents, summed by
  language; languages of a family weigh the same in it, and families are equally likely.
* Language inside a family: one soft-margin linear support vector machine for each pair, on square
  roots of relative frequencies (vectors of length one). Each machine is fitted in a Spark group of
  its own, on at most ``SAMPLE`` documents of either language, chosen by a hash of id and text. The
  language that wins most pairs is predicted; ties go to the larger sum of margins, then by name.

Families come from the table ``FAMILIES``; a language that is not in it is a family of its own.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every text if
there is nothing to learn from; a null id counts as the empty text in the hold-out rule, so it is
held out; repeated rows are rows of their own; empty tables give empty results; other columns are
ignored.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Buckets of features and lengths of letter runs.
DIMS = 1 << 14
ORDERS = (1, 2, 3)
#: Documents of a language that each of its machines is fitted on.
SAMPLE = 500
#: Documents, and code points, that are looked at together in a task.
DOCS = 128
CHARS = 400_000
#: Bytes of machines that one pass over the documents carries; more families take more passes.
MODEL_BYTES = 64 << 20
#: Language vectors of counts that a task holds before it hands them on.
HELD = 64
UNKNOWN = "und"

#: Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ca es fr gl it la lmo oc pt ro sc wa",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv kw",
    "uralic": "et fi hu se",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "iranian": "fa ku ps tg",
    "indic": "as bn gu hi mr ne or pa sa sd si ur",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt ti",
    "austronesian": "ceb fil id jv mg mi ms sm su tl",
    "sinitic": "wuu yue zh",
    "bantu": "rw sn sw xh zu",
}


def family_of(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((name for name, codes in FAMILIES.items() if code in codes.split()), f"only {lang}")


@functools.cache
def _kept() -> np.ndarray:
    """Whether a code point is a letter or a mark."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), bool, 0x110000)


def letters(text: str | None) -> np.ndarray:
    """Code points of a text in lower case, spaces for all but letters and marks, one space at both ends."""
    codes = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_kept()[codes], codes, 32)
    blank = codes == 32
    return codes[~(blank & np.concatenate([[False], blank[:-1]]))]


def buckets(codes: np.ndarray, order: int) -> np.ndarray:
    """The bucket of each run of ``order`` code points."""
    n = len(codes) - order + 1
    h = np.full(max(n, 0), order, np.uint64)
    for at in range(order):
        h = (h ^ codes[at : at + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(20)) % np.uint64(DIMS)


def counts_of(texts: list[str | None]) -> np.ndarray:
    """Bucket counts, a row for each text."""
    out = np.zeros((len(texts), DIMS), np.float32)
    for row, text in enumerate(texts):
        codes = letters(text)
        if len(codes) <= 1:
            continue
        for start in range(0, len(codes), CHARS):
            for order in ORDERS:
                part = codes[start : start + CHARS + order - 1]
                out[row] += np.bincount(buckets(part, order).astype(np.int64), minlength=DIMS)
    return out


def unit(counts: np.ndarray) -> np.ndarray:
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Linear soft-margin support vector machine by coordinate descent on its dual; both classes weigh
    the same. The bias is a constant feature."""
    gram = (x @ x.T).astype(np.float64) + 1
    most = cost * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    a, f, rnd = np.zeros(len(y)), np.zeros(len(y)), np.random.default_rng(1)
    for _ in range(rounds):
        moved = 0.0
        for i in rnd.permutation(len(y)):
            step = min(max(a[i] + (1 - y[i] * f[i]) / gram[i, i], 0), most[i]) - a[i]
            if step:
                a[i] += step
                f += step * y[i] * gram[i]
                moved = max(moved, abs(step))
        if moved < 1e-3 * cost:
            break
    return ((a * y) @ x).astype(np.float32), float((a * y).sum())


class Model:
    """``family`` holds log-probabilities of the buckets by family; ``machines`` those of each family's pairs."""

    def __init__(self, counts: dict[str, np.ndarray], machines: dict[tuple[str, str], tuple[np.ndarray, float]]):
        self.languages: dict[str, list[str]] = {}
        for lang in sorted(counts):
            self.languages.setdefault(family_of(lang), []).append(lang)
        self.families = sorted(self.languages)
        self.log = np.zeros((len(self.families), DIMS), np.float32)
        for k, name in enumerate(self.families):
            smooth = [(counts[x] + 0.5) / (counts[x].sum() + 0.5 * DIMS) for x in self.languages[name]]
            self.log[k] = np.log(np.mean(smooth, axis=0))
        self.machines = machines

    def parts(self, most: int = MODEL_BYTES) -> list[list[str]]:
        """Families dealt to passes, so that the machines of a pass stay below ``most`` bytes (or are of one family)."""
        out, held = [[]], 0
        for name in self.families:
            n = len(self.languages[name])
            need = n * (n - 1) // 2 * DIMS * 4
            if out[-1] and held + need > most:
                out.append([])
                held = 0
            out[-1].append(name)
            held += need
        return out

    def only(self, families: list[str], first: bool) -> "Pass":
        langs = {x for name in families for x in self.languages[name]}
        return Pass(self, set(families), {k: v for k, v in self.machines.items() if k[0] in langs}, first)


class Pass:
    """What one pass over the documents needs: all families, the machines of some."""

    def __init__(self, model: Model, mine: set[str], machines: dict, first: bool):
        self.families, self.languages, self.log, self.mine, self.machines, self.first = model.families, model.languages, model.log, mine, machines, first

    def predict(self, texts: list[str | None]) -> list[tuple[str, float] | None]:
        """Language and score of each text; None where its family belongs to another pass."""
        counts = counts_of(texts)
        n = counts.sum(axis=1)
        out: list[tuple[str, float] | None] = [(UNKNOWN, 0.0) if self.first else None] * len(texts)
        if not self.families:
            return out
        # of the evidence, runs that overlap, as much as 30 runs have is counted
        mean = (counts @ self.log.T).astype(np.float64) / np.maximum(n, 1)[:, None] * np.minimum(n, 30)[:, None]
        share = np.exp(mean - mean.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        for k in set(best[n > 0].tolist()):
            if self.families[k] not in self.mine:
                for i in np.flatnonzero((best == k) & (n > 0)):
                    out[i] = None
                continue
            rows, langs = np.flatnonzero((best == k) & (n > 0)), self.languages[self.families[k]]
            x = unit(counts[rows])
            wins, sums, least = (np.zeros((len(rows), len(langs))) for _ in range(3))
            least += np.inf
            for i, j in combinations(range(len(langs)), 2):
                w, b = self.machines[langs[i], langs[j]]
                m = x @ w + b
                for c, s in ((i, m), (j, -m)):
                    wins[:, c] += s > 0 if c == i else s >= 0
                    sums[:, c] += s
                    least[:, c] = np.minimum(least[:, c], s)
            for r, i in enumerate(rows):
                c = max(range(len(langs)), key=lambda c: (wins[r, c], sums[r, c], -c))
                out[i] = (langs[c], float(share[i, k] / (1 + np.exp(-2 * min(max(least[r, c], -20), 20)))))
        return out


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def handed() -> Iterator[pa.RecordBatch]:
        for lang, total in held.items():
            at = np.flatnonzero(total)
            yield pa.record_batch({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(total[at].astype(np.int64))})
        held.clear()

    for b in common.slices(batches, DOCS):
        langs = b["lang"].to_pylist()
        counts = counts_of(b["text"].to_pylist())
        for lang in set(langs):
            mine = np.array([x == lang for x in langs])
            total = held.setdefault(lang, np.zeros(DIMS, np.float64))
            total += counts[mine].sum(axis=0, dtype=np.float64)
        if len(held) > HELD:
            yield from handed()
    yield from handed()


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in common.slices(batches, DOCS):
        sparse = [(np.flatnonzero(row), row) for row in counts_of(b["text"].to_pylist())]
        yield pa.record_batch({
            "lang": b["lang"],
            "key": b["key"],
            "buckets": pa.array([at.astype(np.int32) for at, _ in sparse], pa.list_(pa.int32())),
            "counts": pa.array([row[at] for at, row in sparse], pa.list_(pa.float32())),
        })


def _fitted(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["lang", "key"], kind="stable")
    x = np.zeros((len(group), DIMS), np.float32)
    for i, (at, n) in enumerate(zip(group["buckets"], group["counts"])):
        x[i, at] = n
    first = group["first"].iloc[0]
    w, b = machine(unit(x), np.where(group["lang"] == first, 1.0, -1.0))
    return pd.DataFrame({"first": [first], "second": [group["second"].iloc[0]], "weights": [w], "bias": [b]})


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on all rows of ``docs`` that have a language and are not held out."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    rows = docs.filter(F.col(lang_col).isNotNull() & ~held_out(id_col)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    sums = rows.select("lang", "text").mapInArrow(_sums, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = {}
    for lang, part in sums.groupby("lang"):
        counts[lang] = np.zeros(DIMS)
        counts[lang][part["bucket"].to_numpy()] = part["n"].to_numpy()
    pairs = [(a, b) for a, b in combinations(sorted(counts), 2) if family_of(a) == family_of(b)]
    machines = {}
    if pairs:
        # about four times the sample by the hash alone, so that only few rows of a large language are ranked
        sizes = rows.groupBy("lang").count().filter(F.col("lang").isin(sorted({x for p in pairs for x in p})))
        keyed = rows.withColumn("key", F.xxhash64(F.col("id").cast("string"), "text"))
        near = keyed.join(F.broadcast(sizes), "lang").filter(F.pmod("key", F.lit(1 << 30)) * F.col("count") < F.lit(float(4 * sample * (1 << 30))))
        rank = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
        chosen = near.withColumn("rank", rank).filter(F.col("rank") <= sample).select("lang", "key", "text")
        vectors = chosen.mapInArrow(_vectors, "lang string, key bigint, buckets array<int>, counts array<float>")
        both = spark.createDataFrame([(x, a, b) for a, b in pairs for x in (a, b)], "lang string, first string, second string")
        fitted = vectors.join(F.broadcast(both), "lang").groupBy("first", "second").applyInPandas(_fitted, "first string, second string, weights array<float>, bias double")
        for r in fitted.toLocalIterator():
            machines[r["first"], r["second"]] = (np.array(r["weights"], np.float32), r["bias"])
    return Model(counts, machines)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", model_bytes: int = MODEL_BYTES) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    kind = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double"
    out = None
    for k, families in enumerate(model.parts(model_bytes)):
        sent = spark.sparkContext.broadcast(model.only(families, k == 0))

        def judged(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in common.slices(batches, DOCS):
                found = sent.value.predict(b["text"].to_pylist())
                mine = pa.array([x is not None for x in found], pa.bool_())
                kept = [x for x in found if x is not None]
                yield pa.record_batch({
                    "doc_id": b["doc_id"].filter(mine),
                    "held_out": b["held_out"].filter(mine),
                    "lang_pred": pa.array([x[0] for x in kept], pa.string()),
                    "score": pa.array([x[1] for x in kept], pa.float64()),
                })

        part = rows.mapInArrow(judged, kind)
        out = part if out is None else out.unionByName(part)
    return out


def identify(docs: DataFrame, **cols: str) -> DataFrame:
    """Train on the rows that are not held out, predict for all."""
    return predict(docs, train(docs, **cols), **{k: v for k, v in cols.items() if k != "lang_col"})
