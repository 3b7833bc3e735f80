"""Steps whose cost must not grow faster than the input."""

import pyarrow as pa
import pytest

from plumbline.functions import binary
from plumbline.operators import surfaces
from plumbline.plans import queries_surfaces
from plumbline.sources import arrays

SMALL = "/root/testdata/sf0.001"


def test_stores_of_surfaces_are_never_broadcast(spark, monkeypatch):
    plans, store = [], surfaces.store_table

    def stored(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df)

    monkeypatch.setattr(surfaces, "store_table", stored)
    surfaces.audit(queries_surfaces.planted(spark, SMALL), most_bytes=queries_surfaces.MOST_BYTES)
    joined = [p for p in plans if "Join" in p and "objects" in p]
    assert len(joined) == 1 and "Broadcast" not in joined[0]


def test_batches_are_cut_to_slices():
    batches = [pa.RecordBatch.from_pydict({"n": list(range(n))}) for n in (0, 5, 700)]
    cut = list(arrays.slices(iter(batches)))
    assert max(b.num_rows for b in cut) <= arrays.SLICE_ROWS
    assert [n for b in cut for n in b["n"].to_pylist()] == [*range(5), *range(700)]


def test_few_bytes_are_summed_without_steps_of_arrays(monkeypatch):
    blobs = [bytes(range(n % 256)) * (1 + n // 256) for n in (0, 1, 3, 4, 64, 255, 700)]
    few = [int(binary.crc32c_of([b])[0]) for b in blobs]
    monkeypatch.setattr(binary, "FEW_BYTES", -1)
    assert binary.crc32c_of(blobs).tolist() == few
    monkeypatch.undo()
    monkeypatch.setattr(binary, "_steps", None)
    assert binary.crc32c_of([b"123456789"]).tolist() == [0xE3069283]


def test_all_present_levels_are_read_back(spark):
    from plumbline.plans import queries_sources, tables

    want = tables.levels(spark, SMALL).filter("present").count()
    assert queries_sources.levels_jsonl(spark, SMALL).count() == want


def test_keys_of_a_planted_store_are_put_in_order_once():
    from plumbline.sources.transport import PlantedStore, listed_pages

    class Objects(dict):
        walks = 0

        def __iter__(self):
            self.walks += 1
            return super().__iter__()

    objects = Objects({f"{'abc'[n % 3]}/{n:03}": b"x" for n in range(300)})
    store = PlantedStore(objects)
    for prefix, after in (("", ""), ("b/", ""), ("b/", "b/100"), ("", "b/\U0010ffff"), ("x", "")):
        found = [k for keys, _, _ in listed_pages(store, prefix, after, size=3) for k, _ in keys]
        assert found == sorted(k for k in objects.keys() if k.startswith(prefix) and k > after)
    branches = [b for _, own, _ in listed_pages(store, "", "a/", "/", 1) for b in own]
    assert branches == ["b/", "c/"] and objects.walks == 1


def test_questions_are_closed_without_python_strings():
    from plumbline.llm import kneser_ney

    parts = list(kneser_ney.closed(pa.array(["abc", "abd", "bca"]), 3))
    assert all(isinstance(p, pa.Array) for p in parts)
    got = [g for p in parts for g in p.to_pylist()]
    # all suffixes, and each of them without its last character
    assert sorted(got) == sorted({"abc", "abd", "bca", "bc", "bd", "ca", "c", "d", "a", "", "ab", "b"})


def test_levels_are_planted_in_their_own_rows(spark):
    from plumbline.plans import queries_content, tables

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = queries_content.planted(spark, SMALL)
    count = lambda text: (text.count("Exchange hash"), text.count("Generate explode"), text.count("Join"))
    assert count(plan(rows)) == count(plan(tables.levels(spark, SMALL)))


def test_rows_of_a_batch_are_those_of_to_pylist():
    batch = pa.RecordBatch.from_pydict({
        "s": pa.array(["x", None, "\u00e9", ""]), "n": pa.array([1, None, 3, 4]), "i": pa.array([1, 2, 3, 4], pa.int32()), "b": pa.array([True, None, False, True]),
        "m": pa.array([[("a", b"1"), ("b", None)], None, [], [("c", b"")]], pa.map_(pa.string(), pa.binary())), "l": pa.array([[1, 2], None, [], [3, None]], pa.list_(pa.int64())),
    })
    for part in (batch, batch.slice(1), batch.slice(1, 2), batch.slice(0, 0), batch.slice(3)):
        assert list(arrays.rows_of(part)) == part.to_pylist()


def test_small_levels_are_one_step_of_a_census(spark):
    from plumbline.operators import census

    shape = "root string, path string, present boolean, shape array<bigint>, chunks array<bigint>, dtype string, compressor_id string, separator string, zarr_format int, objects map<string, binary>, faults map<string, int>"
    level = lambda root, n, faults: (root, "0", True, [2 * n, 6], [2, 2], "<f4", "none", "/", 2, {f"{root}/0/{i}/{j}": bytes(16 - (i == 1)) for i in range(n) for j in range(3)}, faults)
    rows = spark.createDataFrame([level("a", 4, {}), level("b", 20, {}), level("c", 20, {"c/0/3": 503}), level("d", 4, {"d/0": 500}), level("e", 4, {"e/0/1/1": 503})], shape)
    levels = rows.withColumnRenamed("path", "level")
    said = lambda found: {r.root: r[1:] for r in found.select("root", "n", "error", "least", "most", "total", "raw", "packed").collect()}
    one = census.visits(levels, None, 5, 3, None)
    assert sorted(r.root for r in one.filter("large").collect()) == ["b", "c"]
    spread, small = said(census.spread_visits(levels, None, 5, 3, None)), said(one.filter("not large"))
    assert all(spread[root] == found for root, found in small.items()) and sorted(small) == ["a", "d", "e"]
    got = {r.root: r.present_chunks for r in census.census(rows, head_sample=5, read_sample=3).collect()}
    assert got == {"a": 12, "b": 60, "c": None, "d": None, "e": 12}


def test_tables_of_counts_go_when_the_model_is_stored(spark, tmp_path):
    from collections import Counter

    from plumbline.llm import common, kneser_ney

    texts = [("de", "aba\u00e9aba"), ("de", "ab"), ("en", "ab \U0001f600 ab"), ("en", "b")]
    rows = spark.createDataFrame(texts, "lang string, text string")
    want = Counter((lang, (kneser_ney.START * 2 + t)[i : i + 3]) for lang, t in texts for i in range(len(t)))
    kept, store = [], common.stored
    counted = common.stored(kneser_ney.counts(rows, 3))
    assert {(r.lang, r.gram): r.c for r in counted.collect()} == want
    try:
        common.stored = lambda df: kept.append(store(df)) or kept[-1]
        model = kneser_ney.model(counted, 3)
    finally:
        common.stored = store
    import os

    there = [os.path.isdir(t.inputFiles()[0].removeprefix("file://").rpartition("/")[0]) for t in kept]
    # counts of three orders are gone, their discounts and the model stay
    assert there == [False, False, False, True, True] and model.count() > len(want)


@pytest.mark.parametrize("name", ["j14_truth_and_tools", "a26_hit_matrix", "l06_first_of_each"])
def test_the_audit_runs_once_where_it_is_read_twice(spark, name):
    """What is read again is a stored table, so no plan beyond it goes back to the levels."""
    from plumbline.plans import registry

    assert not any("lineitem" in f for f in registry.QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles())


def test_the_audit_deals_levels_once_and_gathers_none(spark):
    plan = registry_plan(spark, "r00_audit")
    # lines, and orders if they are many; windows and the join find them in place
    assert plan.count("Exchange hashpartitioning") <= 2 and "Aggregate" in plan and "ObjectHashAggregate" not in plan


def test_the_audit_is_not_run_again_to_put_its_rows_in_order(spark, monkeypatch):
    from plumbline.plans import queries_audit

    dealt, placed = [], queries_audit.sampling.placed
    monkeypatch.setattr(queries_audit.sampling, "placed", lambda rows, *a: dealt.append(rows) or placed(rows, *a))
    queries_audit.gate_order(spark, SMALL)
    assert "Generate" not in dealt[0]._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in registry_plan(spark, "l02_registry_order")


def registry_plan(spark, name):
    from plumbline.plans import registry

    return registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
