"""Language identification: features by definition, machines by their optimality conditions, held-out accuracy, hard rows."""

import collections
import random
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import common, language_id, queries

SCHEMA = "doc_id bigint, text string, lang string, held_out string, lang_pred int, score string, n bigint, key string, id string"
SYLLABLES = {"en": "the ing and wh th", "de": "sch ung ein ß ä", "nl": "ij oe aa een zij", "fr": "é eau que ç oi", "es": "ñ ción aja dad í", "ru": "ов ени ст пр ых", "xx": "qa zu ki mo wo"}


def prose(lang, rnd, words=40):
    own = SYLLABLES[lang].split()
    return " ".join("".join(rnd.choice(own) for _ in range(rnd.randrange(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(5)
    rows = [(i, prose(lang, rnd, rnd.randrange(3, 60)), lang, "h", 1, "s", 2, "k", "i") for i, lang in enumerate(rnd.choice(list(SYLLABLES)) for _ in range(700))]
    odd = [(1001, None, "en"), (1002, "", "de"), (1003, " 12 !?\n", "fr"), (None, prose("ru", rnd), "en"), (1004, prose("es", rnd), None), (1005, prose("de", rnd, 60_000), "de"), (1006, "퟿ \U0001f600 ab", "xx")]
    rows += [(i, t, lang, "h", 1, "s", 2, "k", "i") for i, t, lang in odd] + [rows[0], rows[0]]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_features_by_definition():
    rnd = random.Random(1)
    for _ in range(50):
        text = "".join(rnd.choice("aB é1-\n中İ́") for _ in range(rnd.randrange(0, 60)))
        plain = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in f" {text} ".lower())
        while "  " in plain:
            plain = plain.replace("  ", " ")
        assert "".join(map(chr, language_id.letters(text))) == plain
        want = collections.Counter()
        if plain != " ":
            for order in language_id.ORDERS:
                for at in range(len(plain) - order + 1):
                    run = np.array([ord(c) for c in plain[at : at + order]], np.uint32)
                    want[int(language_id.buckets(run, order)[0])] += 1
        got = language_id.counts_of([text])[0]
        assert {int(i): int(got[i]) for i in np.flatnonzero(got)} == dict(want)


def test_slices_of_a_long_text_add_up(monkeypatch):
    text = prose("fr", random.Random(2), 3000)
    whole = language_id.counts_of([text])
    monkeypatch.setattr(language_id, "CHARS", 101)
    assert (language_id.counts_of([text]) == whole).all()


def test_machine_is_optimal():
    """Karush-Kuhn-Tucker conditions: no point inside the margin without the full weight, none outside with any."""
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(80, 12)).astype(np.float32)
    y = np.where(x[:, 0] + 0.3 * rnd.normal(size=80) > 0.4, 1.0, -1.0)
    w, b = language_id.machine(x, y, rounds=3000)

    def loss(w, b):
        most = 10.0 * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
        return (w @ w + b * b) / 2 + (most * np.maximum(0, 1 - y * (x @ w + b))).sum()

    best = loss(w.astype(float), b)
    for _ in range(300):
        assert loss(w + rnd.normal(size=12) * 0.02, b + rnd.normal() * 0.02) >= best * (1 - 2e-3)


def test_predictions(spark, docs):
    model = language_id.train(docs)
    assert model.languages == {"germanic": ["de", "en", "nl"], "only xx": ["xx"], "romance": ["es", "fr"], "slavic": ["ru"]}
    rows = language_id.predict(docs, model)
    assert rows.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = {r.doc_id: r for r in rows.collect()}
    assert rows.count() == docs.count() and all(0 <= r.score <= 1 for r in got.values())
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0)
    assert [got[i].lang_pred for i in (1001, 1002, 1003)] == ["und"] * 3 and got[None].lang_pred == "ru"
    assert got[1005].lang_pred == "de" and got[1004].lang_pred == "es"
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect() if r.doc_id is not None and r.doc_id < 700}
    unseen = [i for i in truth if got[i].held_out]
    assert np.mean([got[i].lang_pred == truth[i] for i in unseen]) > 0.97
    # several passes give what one gives
    passes = language_id.predict(docs, model, model_bytes=1)
    assert sorted(map(tuple, passes.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)


def test_only_training_rows_teach(docs):
    """Languages of held-out rows change nothing."""
    held = language_id.held_out("doc_id")
    other = docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang")))
    assert sorted(map(tuple, language_id.identify(other).collect()), key=repr) == sorted(map(tuple, language_id.identify(docs).collect()), key=repr)


def test_nothing_to_learn(spark, docs):
    none = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert none.count() == docs.count() and none.filter("lang_pred != 'und' or score != 0").count() == 0
    assert language_id.identify(docs.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = common.table(spark, sf, "documents")
    rows = queries.QUERIES["op11_language_id"](spark, sf).filter("held_out").join(docs, "doc_id")
    assert rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98
