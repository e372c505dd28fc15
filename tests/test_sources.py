import csv
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from core_rows import log_row
from obslab.operators import versions
from obslab.operators.models import Variant
from obslab.operators.prepare import prepare_dataset
from obslab.plans import retraining
from obslab.session import shared_dir
from obslab.sources import files, observation_log, tables
from obslab.sources.snapshots import SnapshotStore
from obslab.spec import BODY_MEASURES

SPEC = replace(BODY_MEASURES, key=("row",))
HEADER = ",".join(observation_log.log_columns(BODY_MEASURES))
GOOD = "2026-01-01T00:00:00Z,Dream,50.5,18,201,4300,,Adelie,0.9,0.1,0.0,Chinstrap"


def test_csv_table_with_missing_words(spark, tmp_path):
    path = tmp_path / "table.csv"
    path.write_text(
        "species,island,bill_length_mm,bill_depth_mm,flipper_length_mm,body_mass_g,sex,year\n"
        "Adelie,Torgersen,39.1,18.7,181,3750,male,2007\nAdelie,Torgersen,NA,NA,NA,NA,NA,2007\n")
    rows = tables.load_table(spark, str(path), BODY_MEASURES, "csv").collect()
    assert rows[0]["bill_length_mm"] == 39.1 and rows[1]["body_mass_g"] is None and rows[1]["sex"] is None
    with pytest.raises(FileNotFoundError):
        tables.load_table(spark, f"{tmp_path}/absent.csv", BODY_MEASURES, "csv")
    (tmp_path / "other.csv").write_text("species,island\nAdelie,Dream\n")
    with pytest.raises(ValueError, match="bill_depth_mm.*sex"):
        tables.load_table(spark, f"{tmp_path}/other.csv", BODY_MEASURES, "csv")


def test_unreadable_measures_of_a_csv_table(spark, tmp_path):
    head = "species,island,bill_length_mm,bill_depth_mm,flipper_length_mm,body_mass_g,sex,row\n"
    lines = [f"Adelie,Torgersen,{x},18.7,181,{3750 + i},male,{i}" for i, x in enumerate(("39.1", "12mm", "3,7", "40.5"))]
    (tmp_path / "t.csv").write_text(head + "\n".join(lines).replace("3,7", '"3,7"') + "\n")
    with pytest.raises(Exception, match="bill_length_mm: not a number"):
        tables.load_table(spark, f"{tmp_path}/t.csv", BODY_MEASURES, "csv").collect()
    table = tables.load_table(spark, f"{tmp_path}/t.csv", SPEC, "csv", as_text=True)
    log, _ = observation_log.read_log(spark, f"{tmp_path}/none.csv", BODY_MEASURES)
    prepared = prepare_dataset(table, log.withColumn("row", F.lit("0")), SPEC, strict=False)
    assert prepared.snapshot.count() == 2 and prepared.quarantine.count() == 2
    with pytest.raises(ValueError, match="bill_length_mm:invalid_number"):
        prepare_dataset(table, log.withColumn("row", F.lit("0")), SPEC)


def test_header_is_the_first_line_and_no_other(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "a.csv").write_text(f"{HEADER}\n{GOOD}\n{HEADER}\n{HEADER}\n")
    rows, quarantine = observation_log.read_log(spark, str(folder), BODY_MEASURES)
    assert rows.count() == 3 and quarantine.count() == 0
    (folder / "b.csv").write_text(f"{GOOD}\n{HEADER}\n")
    with pytest.raises(ValueError, match="header differs|required columns"):
        observation_log.read_log(spark, str(folder), BODY_MEASURES)


def test_empty_file_in_a_log_is_an_error(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "a.csv").write_text(f"{HEADER}\n{GOOD}\n")
    (folder / "b.csv").write_text("")
    with pytest.raises(ValueError, match="empty"):
        observation_log.read_log(spark, str(folder), BODY_MEASURES)


@pytest.fixture
def small_splits(spark):
    """Files are cut every 97 bytes, also inside lines and quoted values."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {k: spark.conf.get(k, None) for k in keys}
    for key, value in zip(keys, ("97", "0", "1")):
        spark.conf.set(key, value)
    yield
    for key, value in old.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_a_record_over_two_lines_is_read_whole(spark, tmp_path):
    split = GOOD.replace("Dream", '"Dre\nam"')
    (tmp_path / "log.csv").write_text(f"{HEADER}\n{GOOD}\n{split}\n5\"{GOOD[4:]}\n")
    rows, quarantine = observation_log.read_log(spark, f"{tmp_path}/log.csv", BODY_MEASURES)
    assert sorted(r.island for r in rows.collect()) == ["Dre\nam", "Dream"]
    assert [r.line for r in quarantine.collect()] == [5]
    with pytest.raises(ValueError, match="log.csv: line 5: "):
        observation_log.require_intact(quarantine)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_splits_inside_quoted_values_agree_with_a_plain_reader(spark, tmp_path, small_splits, end):
    draw = random.Random(7)
    folder = tmp_path / "log"
    folder.mkdir()
    want = []
    for name in ("a.csv", "b.csv"):
        records = []
        for i in range(40):
            island = draw.choice([f"Dream{i}", f"D,{i}", f"two{end}lines {i}", f'say ""x"" {i}{end}{end}and "" on{end}', f'{end}{i},"",1{end}', f"long {'y' * 150}{end}{i}"])
            records.append(GOOD.replace("Dream", f'"{island}"'))
        (folder / name).write_text(end.join([HEADER, *records, ""]), newline="")
        with open(folder / name, newline="") as file:
            want += [tuple(r) for r in list(csv.reader(file, strict=True))[1:]]
    rows, quarantine = observation_log.read_log(spark, str(folder), BODY_MEASURES)
    assert quarantine.count() == 0
    assert sorted(tuple(v or "" for v in r) for r in rows.collect()) == sorted(want)


def test_a_stray_quote_loses_only_its_own_line(spark, tmp_path, small_splits):
    split = GOOD.replace("Dream", '"Dre\nam"')
    text = "\n".join([HEADER, GOOD, GOOD[:-9] + '"open', GOOD, split, "1,2", split, GOOD, ""])
    (tmp_path / "log.csv").write_text(text)
    rows, quarantine = observation_log.read_log(spark, f"{tmp_path}/log.csv", BODY_MEASURES)
    assert sorted(r.island for r in rows.collect()) == ["Dre\nam"] * 2 + ["Dream"] * 3
    assert sorted((r.line, r.corrupt_record) for r in quarantine.collect()) == [(3, GOOD[:-9] + '"open'), (7, "1,2")]


def test_absent_log_has_no_rows(spark, tmp_path):
    rows, broken = observation_log.read_log(spark, f"{tmp_path}/none.csv", BODY_MEASURES)
    assert rows.count() == 0 and broken.count() == 0 and rows.columns == HEADER.split(",")


@pytest.mark.parametrize("text", ["", "\n\n", "species,bill_length_mm\nAdelie,44\n"])
def test_missing_header_is_an_error(spark, tmp_path, text):
    (tmp_path / "log.csv").write_text(text)
    with pytest.raises(ValueError, match="line 1.*missing"):
        observation_log.read_log(spark, f"{tmp_path}/log.csv", BODY_MEASURES)


def test_repeated_header_names_are_an_error(spark, tmp_path):
    (tmp_path / "log.csv").write_text(f"{HEADER},sex\n")
    with pytest.raises(ValueError, match="repeated"):
        observation_log.read_log(spark, f"{tmp_path}/log.csv", BODY_MEASURES)


def test_broken_records_are_quarantined(spark, tmp_path):
    broken = ['"unterminated', "1,2,3", GOOD + ",extra", GOOD[:-9] + '"open', GOOD.replace("Dream", '"Dre"am')]
    quoted = GOOD.replace("Dream", '"Dream, ""west"""')
    text = "﻿" + "\n".join([HEADER, GOOD, "", *broken, quoted]) + "\n"
    (tmp_path / "log.csv").write_text(text, encoding="utf-8")
    rows, quarantine = observation_log.read_log(spark, f"{tmp_path}/log.csv", BODY_MEASURES)
    assert sorted(r["island"] for r in rows.collect()) == ["Dream", 'Dream, "west"']
    assert rows.count() == 2 and quarantine.count() == 5
    assert sorted(r["corrupt_record"] for r in quarantine.collect()) == sorted(broken)
    with pytest.raises(ValueError, match="cannot be read"):
        observation_log.require_intact(quarantine)


def test_all_files_of_a_log_need_the_same_header(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "a.csv").write_text(f"{HEADER}\n{GOOD}\n")
    (folder / "b.csv").write_text(f"{HEADER}\n{GOOD}\n")
    assert observation_log.read_log(spark, str(folder), BODY_MEASURES)[0].count() == 2
    (folder / "c.csv").write_text(f"{GOOD}\n")
    with pytest.raises(ValueError, match="header differs"):
        observation_log.read_log(spark, str(folder), BODY_MEASURES)


def scored(spark, *confirmed):
    rows = [("Dream", 50.5, 18.0, 201.0, 4300.0, "male", "Adelie", {"Adelie": 0.9, "Chinstrap": 0.1, "Gentoo": 0.0}, c)
            for c in confirmed]
    return spark.createDataFrame(
        rows, "island string, bill_length_mm double, bill_depth_mm double, flipper_length_mm double, body_mass_g double, "
              "sex string, predicted_species string, probabilities map<string,double>, validated_species string")


def test_log_appends_keep_the_confirmed_label_apart(spark, tmp_path):
    path = f"{tmp_path}/log"
    observation_log.append_log(scored(spark, "", None), BODY_MEASURES, path)
    observation_log.append_log(scored(spark, "Gentoo"), BODY_MEASURES, path)
    got = spark.read.parquet(path)
    assert got.columns == HEADER.split(",") and got.count() == 3
    assert sorted(str(r["validated_species"]) for r in got.collect()) == ["Gentoo", "None", "None"]
    assert got.first()["probability_adelie"] == 0.9 and "T" in got.first()["timestamp_utc"]


@pytest.mark.parametrize("label", [" Adelie ", "gentoo", "Emperor"])
def test_unclean_labels_are_refused_and_nothing_is_written(spark, tmp_path, label):
    with pytest.raises(ValueError):
        observation_log.append_log(scored(spark, "Adelie", label), BODY_MEASURES, f"{tmp_path}/log")
    assert not list(tmp_path.rglob("*.parquet"))
    assert observation_log.refused_labels(scored(spark, "Adelie", "", label), BODY_MEASURES).count() == 1


def test_file_fingerprints_and_changes(spark, tmp_path):
    import hashlib

    for name, text in (("a", "one"), ("b", "two")):
        (tmp_path / f"{name}.txt").write_text(text)
    before = spark.createDataFrame(files.file_fingerprints(spark, str(tmp_path), "*.txt").collect())
    assert {r["file"]: r["sha256"] for r in before.collect()}["a.txt"] == hashlib.sha256(b"one").hexdigest()
    (tmp_path / "a.txt").write_text("changed")
    (tmp_path / "c.txt").write_text("new")
    changes = files.fingerprint_changes(before, files.file_fingerprints(spark, str(tmp_path), "*.txt"))
    assert {r["path"].rsplit("/", 1)[1]: r["change"] for r in changes.collect()} == {"a.txt": "changed", "c.txt": "added"}


def test_files_of_any_size_are_read_by_lines(spark, tmp_path, monkeypatch):
    """Each by one task, in pieces: no byte is lost or taken for text, and nothing is as large as the file."""
    import gzip
    import hashlib
    import random

    rng = random.Random(5)
    contents = {
        "a b.bin": rng.randbytes(300_000), "c%20d.bin": rng.randbytes(70_000) + b"\n", "ü+#.bin": b"\xef\xbb\xbfone\r\ntwo\r" * 5000,
        "marked.bin": b"\xef\xbb\xbf" + b"\n" * 30_000, "e.bin": b"x" * 90_000, "f.bin.gz": gzip.compress(rng.randbytes(50_000)), "small.bin": b"s",
    }
    (tmp_path / "deeper").mkdir()
    for i, (name, content) in enumerate(contents.items()):
        (tmp_path / ("deeper" if i % 2 else "") / name).write_bytes(content)
    plain = {tuple(r) for r in files.file_fingerprints(spark, str(tmp_path)).collect()}
    monkeypatch.setattr(files, "WHOLE_BYTES", 1000)
    held = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    # As if no value could hold more: files beyond that were an error.
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 60_000)
    try:
        found = files.file_fingerprints(spark, str(tmp_path))
        assert {tuple(r) for r in found.collect()} == plain and found.columns == ["file", "path", "n_bytes", "sha256"]
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", held)
    assert {(f, n, h) for f, _, n, h in plain} == {(f, len(c), hashlib.sha256(c).hexdigest()) for f, c in contents.items()}


def test_row_locator_is_unique_and_repeatable(spark, tmp_path):
    spark.range(100).select((F.col("id") % 3).alias("v")).repartition(4).write.parquet(f"{tmp_path}/t")
    located = lambda: {r["row_key"] for r in tables.with_row_locator(spark.read.parquet(f"{tmp_path}/t")).collect()}
    assert len(located()) == 100 and located() == located()


def test_result_files(spark, tmp_path):
    frame = spark.createDataFrame([("a", 0.5, 1)], "name string, score double, extra int")
    tables.write_semicolon_csv(frame, f"{tmp_path}/csv", ["name", "score"])
    assert spark.read.option("sep", ";").option("header", True).csv(f"{tmp_path}/csv").first().asDict() == {"name": "a", "score": "0.5"}
    tables.write_documents(frame, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").first()["score"] == 0.5
    with pytest.raises(ValueError, match="score"):
        tables.write_documents(spark.createDataFrame([(float("nan"),)], "score double"), f"{tmp_path}/nan")
    for i, (value, kind) in enumerate((
        ((float("inf"),), "struct<x:double>"), ([1.0, float("nan")], "array<double>"), ({"a": float("nan")}, "map<string,double>"),
        ([({"a": [float("-inf")]},)], "array<struct<m:map<string,array<float>>>>"),
    )):
        with pytest.raises(ValueError, match="score"):
            tables.write_documents(spark.createDataFrame([(value,)], f"score {kind}"), f"{tmp_path}/nested{i}")


def test_version_states(spark):
    events = spark.createDataFrame(
        [("r", 1, "adopt", "v1", "initial"), ("r", 2, "adopt", "v2", "v1"), ("r", 3, "roll_back", "v1", "v2"),
         ("s", 1, "adopt", "w1", "initial")], versions.EVENT_SCHEMA)
    state = versions.version_state(events.repartition(3))
    assert {r["registry"]: (r["active_version"], r["previous_version"], r["n_events"]) for r in state.collect()} == {
        "r": ("v1", "v2", 3), "s": ("w1", "initial", 1)}
    candidates = spark.createDataFrame([("r", "v1"), ("s", "initial"), ("t", "initial")], "registry string, base_version string")
    assert {r["registry"]: r["stale"] for r in versions.stale_candidates(candidates, state).collect()} == {
        "r": False, "s": True, "t": False}


def test_store_versions_adoption_and_return(spark, reference, make_log, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    exact = log_row(row=1, bill_length_mm="49.12345678901235")
    first, _ = retraining.retrain(store, reference, make_log(exact), SPEC, Variant("a", trees=2))
    stored = {r["bill_length_mm"] for r in store.load(first).collect()}
    assert 49.12345678901235 in stored and store.load(first).count() == 37
    assert store.state()["active_version"] == "initial"
    late, _ = retraining.retrain(store, reference, make_log(exact, log_row(row=2)), SPEC, Variant("b", trees=2))
    assert store.activate(first)["active_version"] == first
    with pytest.raises(ValueError, match="stale"):
        store.activate(late)
    log = make_log(exact, log_row(row=2), log_row(row=3, body_mass_g="4400"))
    prepared = prepare_dataset(reference, log, SPEC)
    status = retraining.status(store, prepared, candidate=late)
    assert (status["new_confirmed"], status["can_train"], status["can_adopt"], status["can_roll_back"]) == (2, True, False, True)
    with pytest.raises(ValueError, match="no new"):
        retraining.retrain(store, reference, make_log(exact), SPEC)
    with pytest.raises(ValueError, match="differ"):
        retraining.retrain(store, reference.where("row != 5"), make_log(exact, log_row(row=2)), SPEC)
    assert store.roll_back()["active_version"] == "initial"
    again = store.roll_back()
    assert (again["active_version"], again["previous_version"]) == (first, "initial")
    model = store.load_model()
    assert (model.version, model.variant.name, model.spec.labels) == (first, "a", SPEC.labels) and set(model.ranges) == set(SPEC.numeric)
    scored, refused = store.score(reference.withColumn("body_mass_g", F.lit(99999.0)))
    assert scored.count() + refused.count() == 36 and {r["model_version"] for r in scored.collect()} == {first}
    assert all(r["warnings"] for r in scored.collect()) and store.metrics(first).count() == 2
    store.stage(store.load(first), "staged")
    with pytest.raises(ValueError, match="incomplete"):
        store.load("staged")
    bare = store.save(store.load(first), SPEC, base_version=first)
    with pytest.raises(ValueError, match="no metrics"):
        store.activate(bare)
    with pytest.raises(Exception, match="(?i)already.exists"):
        store._append({"seq": store.state()["seq"] - 1}, {"action": "adopt", "active_version": "x", "previous_version": first})
    broken = replace(model, ranges={"bill_length_mm": (5.0, 1.0)})
    with pytest.raises(ValueError, match="ranges_are_ordered"):
        store.save(store.load(first), SPEC, metrics=store.metrics(first), model=broken, version="unfit")
    with pytest.raises(Exception, match="(?i)already.exists"):
        store.save(store.load(first), SPEC, version=first)
    with pytest.raises(ValueError, match="incomplete"):
        store.activate("v_unknown")
    with pytest.raises(ValueError, match="gate"):
        store.save(store.load(first).where("species != 'Gentoo'"), SPEC, version="half")
    with pytest.raises(ValueError, match="incomplete"):
        store.manifest("half")


def test_shared_folder_follows_the_session(spark):
    assert shared_dir(spark, "x") != shared_dir(spark, "x")


def test_of_two_writers_one_succeeds(spark, tmp_path):
    """Both decide on the same state and write at the same time; the loser learns of it."""
    from threading import Barrier, Thread

    store = SnapshotStore(spark, str(tmp_path))
    for number in range(1, 6):
        state, gate, told = store.state(), Barrier(2), []

        def write(name):
            gate.wait()
            try:
                store._append(state, {"action": "adopt", "active_version": name, "previous_version": state["active_version"]})
                told.append(name)
            except ValueError as error:
                told.append(str(error))

        writers = [Thread(target=write, args=(f"v{number}{side}",)) for side in "ab"]
        for w in writers:
            w.start()
        for w in writers:
            w.join()
        assert sum("another writer" in t for t in told) == 1 and len(told) == 2
        after = store.state()
        assert after["seq"] == number and after["active_version"] in told


def test_a_writer_that_fails_takes_its_claim_back(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    step = {"action": "adopt", "active_version": "v1", "previous_version": None}
    with pytest.raises(KeyError):
        store._append(store.state(), {"action": "adopt"})
    assert not list(tmp_path.glob("claims/*/event-000000000001"))
    assert store._append(store.state(), step)["seq"] == 1
