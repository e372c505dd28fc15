"""Training sets of which contradictions leave few rows or none."""

from __future__ import annotations

import datetime
import warnings

import pytest

from obslab.catalog import models, stores, tables


def write_orders(spark, folder, rows):
    day = datetime.datetime(1997, 1, 1)
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string, o_orderdate timestamp"
    table = [(i, i, status, price, priority, day if old else day.replace(year=2000)) for i, (status, price, priority, old) in enumerate(rows)]
    spark.createDataFrame(table, schema).write.parquet(f"{folder}/orders.parquet")
    return str(folder)


CONTRADICTING = [(status, 150.0 + i, "1-URGENT", True) for i, status in enumerate("FOP")]


@pytest.mark.parametrize("left", [[], [("O", 250.0, "2-HIGH", True), ("F", 350.0, "3-MEDIUM", True)], [("P", 450.0, "2-HIGH", False)]])
def test_stored_versions_of_what_contradictions_leave(spark, tmp_path, left):
    folder = write_orders(spark, tmp_path, CONTRADICTING + left)
    keys = list(range(3, 3 + len(left)))
    got = stores.snapshot_roundtrip(spark, folder)
    assert sorted(r["o_orderkey"] for r in got.collect()) == keys and "record_id" in got.columns
    served = stores.served_version(spark, folder)
    assert sorted(tuple(r) for r in served.collect()) == [(k, True, 0, True) for k in keys]
    assert served.dtypes == [("o_orderkey", "bigint"), ("label_is_known", "boolean"), ("n_warnings", "int"), ("active", "boolean")]


def test_steps_grow_finer_with_the_orders(spark, tmp_path, monkeypatch):
    rows = [(status, 100.0 * i + 30 * n, "1-URGENT", i % 2 == 0) for i in range(40) for n, status in enumerate("FOP")]
    folder = write_orders(spark, tmp_path, rows)
    plain = lambda part: sorted(tuple(r) for r in part.collect())
    steps = lambda **known: {name: getattr(tables, name)(spark, folder, **known) for name in ("step_reference", "step_log")}
    assert {k: plain(v) for k, v in steps().items()} == {k: plain(v) for k, v in steps(finer=True).items()}
    assert stores.prepare_dataset(*steps().values(), tables.STEPS, strict=False).snapshot.count() == 0
    # Four times as many orders as a step of 100 is made for: steps of 25, which tell the three labels apart.
    monkeypatch.setattr(tables, "STEP_ROWS", 30)
    assert stores.prepare_dataset(*steps(finer=True).values(), tables.STEPS, strict=False).snapshot.count() == 120
    assert {"5.00", "6.00", "7.00"} <= {r["price_step"] for r in steps(finer=True)["step_log"].collect()}
    monkeypatch.setattr(models, "Variant", lambda name, **known: models.models.Variant(name, trees=2, depth=3))
    assert {r["model"]: r["n_validation"] for r in models.candidate_vs_baseline(spark, folder).collect()} == {"baseline": 15, "candidate": 15}


@pytest.mark.parametrize("left, lacking", [
    ([], ["has_F", "has_O", "has_P", "not_empty"]), ([("P", 450.0, "2-HIGH", False)], ["has_F", "has_O"]),
    ([(c, 450.0 + 100 * i, "2-HIGH", True) for i, c in enumerate("FOP")], []),
])
def test_a_stored_version_names_the_labels_that_it_lacks(spark, tmp_path, monkeypatch, left, lacking):
    folder = write_orders(spark, tmp_path, CONTRADICTING + left)
    monkeypatch.setattr(stores, "shared_dir", lambda *a: f"{tmp_path}/store")
    monkeypatch.setattr(stores, "new_version_id", lambda: "v1")
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        assert stores.snapshot_roundtrip(spark, folder).count() == len(left)
    store = stores.SnapshotStore(spark, f"{tmp_path}/store")
    assert store.manifest("v1")["lacking"] == lacking and [str(w.message) for w in told if "partial" in str(w.message)] == (
        [f"version 'v1' is partial: it fails {lacking}"] if lacking else [])
    if lacking:
        store.stage(store.load("v1"), "v2")
        with pytest.raises(ValueError, match="gate failed"):
            store.publish("v2", tables.STEPS)
        store.publish("v2", tables.STEPS, metrics=spark.range(1), partial=True)
        with pytest.raises(ValueError, match="incomplete: it fails"):
            store.activate("v2")
    # Rows that are invalid are never stored.
    store.stage(store.load("v1").unionByName(spark.createDataFrame([(9, -1.0, "2-high", "F", "reference", "", "")], store.load("v1").schema)), "v3")
    with pytest.raises(ValueError, match="price_step_is_measure"):
        store.publish("v3", tables.STEPS, partial=True)


def test_a_served_version_learns_from_its_whole_snapshot(spark, tmp_path, monkeypatch):
    folder = write_orders(spark, tmp_path, [("FOP"[i % 3], 100.0 * i, "2-HIGH", i % 5 > 0) for i in range(2100)])
    fitted, fit = [], stores.fit
    monkeypatch.setattr(stores, "Variant", lambda name, **known: models.models.Variant(name, trees=2, **known))
    monkeypatch.setattr(stores, "fit", lambda *a: fitted.append(fit(*a)) or fitted[-1])
    got = stores.served_version(spark, folder)
    assert got.where("label_is_known and active and n_warnings = 0").count() == 2100 and [m.fitted_rows for m in fitted] == [2100]
