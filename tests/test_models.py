from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from core_rows import log_row
from obslab.operators import features, forest_bins, gates, models, profile
from obslab.operators.models import FittedModel, Variant, fit, score
from obslab.operators.prepare import prepare_dataset, source_rows
from obslab.operators.ranges import collect_ranges
from obslab.operators.splits import nested_subsets
from obslab.plans import retraining, study, training
from obslab.spec import BODY_MEASURES

SPEC = replace(BODY_MEASURES, key=("row",))
SMALL = Variant("small", trees=3)


@pytest.fixture(scope="module")
def toy(spark):
    """300 separable rows, a seventh of every class without a category."""
    c, i = F.col("id") % 3, (F.col("id") / 3).cast("int")
    noise = lambda salt: (F.abs(F.xxhash64("id", F.lit(salt))) % 1000) / 1000
    return spark.range(300).select(
        F.col("id").alias("row"),
        F.element_at(F.array(*[F.lit(v) for v in SPEC.labels]), c.cast("int") + 1).alias("species"),
        (35 + c * 10 + noise(1) * 4).alias("bill_length_mm"), (15 + noise(2) * 4).alias("bill_depth_mm"),
        (180 + c * 20 + noise(3) * 9).alias("flipper_length_mm"), (3000 + noise(4) * 900).alias("body_mass_g"),
        F.when(i % 7 != 0, F.when(i % 2 == 0, "female").otherwise("male")).alias("sex"),
        F.lit("Biscoe").alias("island"),
    )


@pytest.fixture(scope="module")
def fitted(toy):
    ranges = collect_ranges(profile.feature_ranges(toy, SPEC))
    return replace(fit(toy, SPEC, SMALL), version="v7", ranges=ranges)


def accuracy(model, rows):
    hits = model.predict(rows).agg(F.avg((F.col("predicted_species") == F.col("species")).cast("int"))).first()[0]
    return hits


def test_separable_rows_are_learnt(toy, fitted):
    assert accuracy(fitted, toy) > 0.95
    assert accuracy(fit(toy, SPEC, Variant("lr", kind="logistic")), toy) > 0.95
    assert gates.probability_violations(fitted.predict(toy), SPEC.labels).count() == 0


def test_unseen_and_missing_categories(spark, toy):
    model = features.fit_features(toy.where("sex = 'male' or sex is null"), SPEC)
    rows = toy.limit(1).drop("sex").select("*", F.explode(F.array(F.lit("male"), F.lit("female"), F.lit(None))).alias("sex"))
    got = features.onehot_table(model, rows, SPEC, ["sex"]).collect()
    assert features.onehot_columns(model, SPEC)[4:] == ["sex_male", "sex_unknown"]
    assert {r["sex"]: (r["sex_male"], r["sex_unknown"]) for r in got} == {"male": (1, 0), "female": (0, 0), None: (0, 1)}


def test_forest_does_not_depend_on_the_layout(toy):
    shown = lambda df: fit(df, SPEC, SMALL).classifier.toDebugString.split("\n", 1)[1]
    assert shown(toy) == shown(toy.orderBy(F.rand(3)).repartition(7))


def test_logistic_regression_zeroes_the_gradient_of_the_penalised_loss(toy):
    """C * sum of log losses + half the squared weights, on population-standardised inputs."""
    model = fit(toy, SPEC, Variant("lr", kind="logistic", c=1.0))
    prepared = model.pipeline.transform(toy).select("features", "species").collect()
    x = np.array([r["features"].toArray() for r in prepared])
    y = np.array([[r["species"] == c for c in SPEC.class_order] for r in prepared], dtype=float)
    assert np.allclose(x[:, :4].mean(0), 0, atol=1e-9) and np.allclose(x[:, :4].std(0), 1)
    weights, bias = model.classifier.coefficientMatrix.toArray(), model.classifier.interceptVector.toArray()
    scores = x @ weights.T + bias
    chances = np.exp(scores - scores.max(1, keepdims=True))
    chances /= chances.sum(1, keepdims=True)
    assert np.abs((chances - y).T @ x + weights).max() < 1e-3
    assert models.coefficient_count(model) == 3 * 7 + 3


def test_scoring_keeps_out_of_range_rows_and_refuses_broken_ones(spark, toy, fitted):
    names = ["row", *SPEC.features]
    rows = [(1, 47.5, 16.0, 218.0, 3100.0, "unknown"), (2, 70.0, 16.0, 200.0, 3100.0, None), (3, None, 16.0, 200.0, 3100.0, "male")]
    schema = "row bigint, bill_length_mm double, bill_depth_mm double, flipper_length_mm double, body_mass_g double, sex string"
    scored, refused = score(spark.createDataFrame(rows, schema), fitted)
    got = {r["row"]: r for r in scored.collect()}
    assert set(got) == {1, 2} and got[1]["model_version"] == "v7"
    assert got[2]["out_of_range"] == ["bill_length_mm"] and got[1]["out_of_range"] == []
    assert "value 70 is outside" in got[2]["warnings"][0]
    assert sum(got[1]["probabilities"].values()) == pytest.approx(1)
    assert refused.first()["errors"] == ["bill_length_mm:missing"]
    with pytest.raises(ValueError, match="refused"):
        score(spark.createDataFrame(rows, schema), fitted, strict=True)
    with pytest.raises(ValueError, match="sex"):
        score(spark.createDataFrame(rows, schema).drop("sex"), fitted)
    places = models.ranked_probabilities(scored, ["row"]).where("row = 1").orderBy("place").collect()
    assert [p["place"] for p in places] == [1, 2, 3] and places[0]["class"] == got[1]["predicted_species"]


def test_saved_model_gives_the_same_probabilities(toy, fitted, tmp_path):
    fitted.save(f"{tmp_path}/model")
    again = FittedModel.load(f"{tmp_path}/model", SPEC, SMALL)
    both = [m.predict(toy).orderBy("row").select("probabilities").collect() for m in (fitted, again)]
    assert both[0] == both[1]


def test_trees_are_wrapped_only_on_demand(toy, fitted, monkeypatch):
    assert len(fitted.classifier.trees) == fitted.variant.trees and fitted.classifier.trees[0].depth >= 1
    monkeypatch.setattr(type(fitted.classifier), "trees", property(lambda self: pytest.fail("trees were wrapped")))
    assert fit(toy, SPEC, SMALL).classifier.getNumTrees == fitted.variant.trees


def test_pca_equals_the_covariance_eigenvectors(toy):
    columns = list(SPEC.numeric)
    got = features.fit_pca(toy, columns, 4)
    x = toy.select("row", *columns).toPandas().set_index("row")
    z = ((x - x.mean()) / x.std(ddof=0)).to_numpy()
    _, sizes, vectors = np.linalg.svd(z, full_matrices=False)
    for vector, loading in zip(vectors, got.loadings):
        assert np.allclose(abs(vector), np.abs(loading)) and max(loading, key=abs) > 0
    assert np.allclose(got.singular_values, sizes)
    assert np.allclose(got.ratios, sizes**2 / (sizes**2).sum())
    scores = features.pca_scores(toy, got, ["row"]).toPandas().set_index("row").loc[x.index]
    assert np.allclose(scores.to_numpy(), z @ np.array(got.loadings).T)
    report = features.pca_report(toy, got).collect()
    assert report[-1]["cumulative_ratio"] == pytest.approx(1)


def test_constant_columns_scale_by_one(spark):
    frame = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    scaled = features.standardise(frame, ["a", "b"], features.fit_scaling(frame, ["a", "b"])).collect()
    assert [(r["a_std"], r["b_std"]) for r in scaled] == [(-1.0, 0.0), (1.0, 0.0)]


def test_grid_and_learning_curve_share_folds(spark, toy, tmp_path):
    folded = study.with_folds(toy, SPEC, folds=3)
    grid = [v.with_trees(2) for v in study.GRID[:2]]
    table = study.cross_validate(folded, SPEC, grid, folds=3)
    rows = table.collect()
    assert len(rows) == 6 and {r["n_train"] + r["n_validation"] for r in rows} == {225}
    summarised = study.summarise_grid(table)
    summary = summarised.collect()
    assert sum(r["recommended"] for r in summary) == 1 and all(r["tree_nodes_mean"] >= 3 for r in summary)
    drawn = study.learning_curve(folded, SPEC, grid[0], folds=3, full=table)
    curve = drawn.collect()
    study.write_study(summarised, drawn, str(tmp_path))
    assert spark.read.option("sep", ";").option("header", True).csv(f"{tmp_path}/learning_curve").count() == 15
    sizes = {(r["fraction"], r["fold"]): r["n_train"] for r in curve}
    assert len(curve) == 15 and all(sizes[1.0, f] == 150 and sizes[0.2, f] == 30 for f in (1, 2, 3))
    full = {r["fold"]: r["validation_macro_f1"] for r in curve if r["fraction"] == 1.0}
    assert full == {r["fold"]: r["validation_macro_f1"] for r in rows if r["variant"] == "dmax-l1"}


def test_bounded_curves_cut_nested_fractions_out_of_one_sample(toy):
    folded = study.with_folds(toy, SPEC, folds=3)
    small = replace(SMALL, fit_rows=60)
    table = study.cross_validate(folded, SPEC, [small], folds=3)
    rows = table.collect()
    assert {(r["n_train"], r["n_validation"]) for r in rows} == {(60, 75)}
    curve = study.learning_curve(folded, SPEC, small, folds=3).collect()
    assert {(r["fraction"], r["n_train"]) for r in curve} == {(0.2, 12), (0.4, 24), (0.6, 36), (0.8, 48), (1.0, 60)}
    # The largest fraction is the plain cross-validation of the bounded variant.
    full = {r["fold"]: r["validation_macro_f1"] for r in curve if r["fraction"] == 1.0}
    assert full == {r["fold"]: r["validation_macro_f1"] for r in rows}
    drawn = models.bounded(toy, SPEC, small).groupBy("species").count().collect()
    assert sorted(r["count"] for r in drawn) == [20, 20, 20]


def test_comparison_reports_the_rows_of_its_fits(reference, make_log):
    snapshot = prepare_dataset(reference, make_log(log_row()), SPEC).snapshot.checkpoint()
    bounded = replace(SMALL, fit_rows=15)
    result = retraining.candidate_vs_baseline(snapshot, source_rows(snapshot, "reference"), SPEC, bounded, SMALL)
    assert {r["model"]: r["n_train"] for r in result.metrics.collect()} == {"baseline": 27, "candidate": 15}


def test_catalog_bounds_the_curve_once_and_compares_whole_training_sets(monkeypatch):
    from obslab.catalog import models as catalog

    used = []
    monkeypatch.setattr(study, "with_folds", lambda *a: None)
    monkeypatch.setattr(study, "learning_curve", lambda df, spec, variant, **known: used.append(variant))
    monkeypatch.setattr(catalog, "_orders", lambda *a: None)
    catalog.learning_curve(None, "")
    for name in ("prepare_dataset", "step_reference", "step_log", "SnapshotStore", "shared_dir", "source_rows"):
        monkeypatch.setattr(catalog, name, lambda *a, **k: type("Any", (), {"snapshot": None, "load": lambda *a: None, "save": lambda *a: None})())
    monkeypatch.setattr(retraining, "candidate_vs_baseline", lambda *a: used.extend(a[3:]) or type("Any", (), {"metrics": None}))
    catalog.candidate_vs_baseline(None, "")
    assert [v.fit_rows for v in used] == [catalog.CURVE_ROWS, None, None]


def test_families_and_ablation(toy):
    rows = study.protocol(toy, SPEC, folds=2)
    families = [v.with_trees(2) for v in study.FAMILIES]
    got = {r["variant"]: r for r in study.family_comparison(rows.where("fold > 0"), SPEC, families, folds=2).collect()}
    assert got["logistic"]["coefficients_mean"] == 3 * 7 + 3 and got["logistic"]["tree_nodes_mean"] is None
    assert got["compact"]["tree_leaves_mean"] >= 3
    both = [Variant("with_island", trees=2, categorical=("sex", "island")), Variant("without_island", trees=2)]
    table = {r["variant"]: r for r in study.ablation(rows, SPEC, both, folds=2).collect()}
    assert table["with_island"]["used_features"].endswith("sex,island") and table["without_island"]["n"] == 75


def test_importance_finds_the_only_useful_features(toy, fitted, monkeypatch):
    losses = {r["feature"]: r["mean_decrease_macro_f1"] for r in study.permutation_importance(fitted, toy, 4).collect()}
    assert set(losses) == set(SPEC.features)
    best = max(losses, key=losses.get)
    assert best in ("bill_length_mm", "flipper_length_mm") and losses[best] > 0.05 and abs(losses["sex"]) < 0.05
    # Small blocks: still every row, once per trial.
    monkeypatch.setattr(study, "BLOCK", 20)
    detail = study.permutation_importance(fitted, toy, 2, detail=True)
    assert detail.count() == 10
    # Few rows, many trials: permutations differ, and so do their losses.
    few = study.permutation_importance(fitted, toy.limit(12), 20, detail=True).where("feature = 'bill_length_mm'")
    assert len({round(r["loss"], 9) for r in few.collect()}) > 2


def test_bins_of_a_forest_give_its_answers(toy, fitted, monkeypatch):
    """Permuted codes lose what permuted rows lose, trial by trial; small blocks, many trials."""
    monkeypatch.setattr(study, "BLOCK", 40)
    both = [{(r["feature"], r["repeat"]): r["loss"] for r in study.permutation_importance(fitted, toy, 5, detail=True, binned=b).collect()}
            for b in (True, False)]
    assert both[0] == both[1] and len(both[0]) == 25 and any(both[0].values())
    bins = forest_bins.forest_bins(fitted)
    assert bins.categories == {"sex": ["female", "male", "unknown"]} and all(t == sorted(set(t)) for t in bins.thresholds.values())
    # Values on, right above and far beyond every threshold, unseen and missing categories.
    edges = [v for t in bins.thresholds["bill_length_mm"] for v in (t, np.nextafter(t, np.inf), np.nextafter(t, -np.inf))] + [-1e308, 1e308]
    rows = toy.limit(3).drop("bill_length_mm", "sex").crossJoin(toy.sparkSession.createDataFrame([(float(v),) for v in edges], "bill_length_mm double"))
    rows = rows.select("*", F.explode(F.array(F.lit("male"), F.lit("never seen"), F.lit(None))).alias("sex"))
    plain = study.confusion_cube(fitted.predict(rows), "species", "predicted_species", ["sex"])
    assert sorted(map(repr, forest_bins.binned_cube(fitted, rows, ["sex"]).select(*plain.columns).collect())) == sorted(map(repr, plain.collect()))
    # Codes that need several longs.
    monkeypatch.setattr(forest_bins, "_CODES", 40)
    assert len(forest_bins.forest_bins(fitted).words) > 1
    again = study.permutation_importance(fitted, toy, 5, detail=True)
    assert {(r["feature"], r["repeat"]): r["loss"] for r in again.collect()} == both[0]


def test_one_draw_for_all_folds_takes_the_rows_of_separate_draws(toy):
    folded = study.with_folds(toy, SPEC, folds=3).cache()
    small = replace(SMALL, fit_rows=50)
    drawn, largest = study.fold_draws(folded, SPEC, small, 3)
    assert largest == drawn.where("drawn_1").count()
    for fold in (1, 2, 3):
        one = models.draw(folded, SPEC, small, "one", F.col("fold") != fold).where("one")
        assert {r["row"] for r in one.collect()} == {r["row"] for r in drawn.where(f"drawn_{fold}").collect()}
    whole, _ = study.fold_draws(folded, SPEC, replace(SMALL, fit_rows=1000), 3)
    assert whole.where("drawn_2").count() == folded.where("fold != 2").count()


def test_cross_validation_scores_as_separate_fits_do(toy):
    folded = study.with_folds(toy, SPEC, folds=3)
    noisy = folded.withColumn("species", F.when(F.xxhash64("row") % 3 == 0, "Adelie").otherwise(F.col("species")))
    small = replace(SMALL, fit_rows=60)
    got = {r["fold"]: (r["validation_accuracy"], r["train_accuracy"]) for r in study.cross_validate(noisy, SPEC, [small], folds=3).collect()}
    for fold in (1, 2, 3):
        model = fit(noisy.where(F.col("fold") != fold), SPEC, small)
        assert got[fold] == tuple(pytest.approx(accuracy(model, noisy.where(c))) for c in (F.col("fold") == fold, F.col("fold") != fold))


def test_release_check(toy, fitted):
    medians = {r["feature"]: r["median"] for r in profile.feature_ranges(toy, SPEC).collect()}
    report = retraining.release_check(fitted, toy, medians).collect()
    assert len(report) == 3 and all(r["passed"] for r in report)
    broken = retraining.release_check(replace(fitted, ranges={"bill_length_mm": (5.0, 1.0)}), toy, medians)
    assert [r["rule"] for r in broken.where("not passed").collect()] == ["ranges_are_ordered"]


def test_training_job(toy):
    result = training.train(toy, SPEC, SMALL, folds=2, repeats=2)
    assert {r["split"]: r["n"] for r in result.sizes.collect()} == {"train": 225, "test": 75}
    assert result.metrics.first()["n"] == 75 and result.matrix.count() == 9 and result.report.count() == 6
    assert result.importance.count() == 5
    document = training.model_metadata(result.deployment, profile.feature_ranges(toy, SPEC)).first()
    assert document["classes"] == list(SPEC.class_order) and document["feature_ranges"]["body_mass_g"]["minimum"] >= 3000
    assert document["model_parameters"]["trees"] == 3


def test_comparison_keeps_the_holdout_out_of_both_fits(spark, reference, make_log, monkeypatch):
    baseline = prepare_dataset(reference, make_log(log_row()).limit(0), SPEC).snapshot.checkpoint()
    candidate = prepare_dataset(reference, make_log(log_row()), SPEC).snapshot.checkpoint()
    held = retraining.reference_holdout(baseline, replace(SPEC, key=("record_id",)))
    again = retraining.reference_holdout(candidate.orderBy(F.desc("row")), replace(SPEC, key=("record_id",)))
    ids = {r["feature_id"] for r in held.collect()}
    assert ids == {r["feature_id"] for r in again.collect()} and len(ids) == 9
    fits = []
    def recorded(rows, spec, variant, placed=False):
        fits.append(({r["feature_id"] for r in rows.collect()} if "feature_id" in rows.columns else None, variant))
        return fit(rows, spec, variant, placed)
    monkeypatch.setattr(retraining, "fit", recorded)
    deep = Variant("baseline", trees=2, depth=None)
    result = retraining.candidate_vs_baseline(candidate, baseline, SPEC, SMALL, deep)
    assert [v.depth for _, v in fits] == [None, 5, 5]
    assert all(not seen & ids for seen, _ in fits[:2]) and len(fits[2][0]) == 37
    sizes = {r["model"]: (r["n_train"], r["n_validation"]) for r in result.metrics.collect()}
    assert sizes == {"baseline": (27, 9), "candidate": (28, 9)}
    assert result.matrices.groupBy("model").agg(F.sum("n").alias("n")).where("n = 9").count() == 2
    assert set(result.deployment.ranges) == set(SPEC.numeric)
    with pytest.raises(ValueError, match="ids_unchanged"):
        retraining.candidate_vs_baseline(candidate.withColumn("body_mass_g", F.col("body_mass_g") + 1), baseline, SPEC, SMALL)
    fewer = baseline.where("row != 1003")
    with pytest.raises(ValueError, match="differ"):
        retraining.candidate_vs_baseline(candidate, fewer, SPEC, SMALL)


@pytest.fixture(autouse=True, scope="module")
def _checkpoints(spark, tmp_path_factory):
    from obslab.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)


def test_the_release_check_asks_the_model_once_per_row(spark, toy):
    import re

    from obslab.operators import gates

    model = fit(toy, SPEC, SMALL)
    asked = lambda df: len(re.findall(r"UDF\(features", df._jdf.queryExecution().optimizedPlan().toString()))
    report = retraining.release_check(model, toy, {c: 1.0 for c in SPEC.numeric})
    assert [tuple(r) for r in report.collect()] == [("predicted_label_is_allowed", 0, True), ("probabilities_are_proper", 0, True)]
    assert asked(report) == 1
    # In the rows found the model's answer is asked for again, in the filter once.
    broken = gates.probability_violations(model.predict(toy).select("probabilities"), SPEC.labels)
    assert asked(broken.groupBy().count()) == 1 and broken.count() == 0


def test_the_split_of_the_lines_is_written_once(spark, tmp_path, monkeypatch):
    from obslab.catalog import models as catalog

    rows = [(i, 1, i, i, 1.0 + i, 10.0 * i, 0.01, 0.02, "ANR"[i % 3], "FO"[i % 2]) for i in range(24)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, "
                          "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    train, test = catalog._line_split(spark, str(tmp_path))
    assert (train.count(), test.count()) == (18, 6) and set(train.columns) == {*catalog._KEY, "l_returnflag", *catalog.LINES.features, "split"}
    assert "md5" not in test._jdf.queryExecution().optimizedPlan().toString()


def test_scoring_asks_the_forest_once_per_combination_of_bins(spark, toy, fitted, monkeypatch):
    """The same answers to the last bit, one question for rows that come ten times; a row without a measure stays an error."""
    many = toy.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(10))))
    asked, plain = [], FittedModel.predict
    monkeypatch.setattr(FittedModel, "predict", lambda self, df: asked.append(df.count()) or plain(self, df))
    scored, refused = score(many, fitted)
    got = {(r["row"], r["copy"]): (r["predicted_species"], r["probabilities"]) for r in scored.collect()}
    assert refused.count() == 0 and 0 < sum(asked) <= 300
    wanted = {(r["row"], r["copy"]): (r["predicted_species"], r["probabilities"]) for r in plain(fitted, many.fillna("unknown", ["sex"])).collect()}
    assert got == wanted and len(got) == 3000
    monkeypatch.setattr(forest_bins, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(forest_bins, "_CODES", 40)
    again = {(r["row"], r["copy"]): (r["predicted_species"], r["probabilities"]) for r in score(many, fitted)[0].collect()}
    assert again == wanted
    missing = toy.limit(1).withColumn("bill_length_mm", F.lit(None).cast("double"))
    with pytest.raises(Exception, match="a measure is missing"):
        forest_bins.predict(fitted, missing).collect()


def test_a_cube_asks_the_forest_once_per_combination_of_bins(toy, fitted, monkeypatch):
    """Keys and labels share the question."""
    rows = toy.limit(20).withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(6))))
    asked, plain = [], FittedModel.predict
    monkeypatch.setattr(FittedModel, "predict", lambda self, df: asked.append(df.count()) or plain(self, df))
    cube = forest_bins.binned_cube(fitted, rows, ["part"])
    assert sum(asked) <= 20 and sum(r["n"] for r in cube.collect()) == 120


def test_trials_of_one_answer_table_count_as_joined_trials_do(toy, fitted, monkeypatch):
    """Labels that are missing, rows that come twice, blocks that end inside a batch: the same counts without forming a row per trial."""
    rows = toy.unionAll(toy.limit(30)).withColumn("species", F.when(F.col("row") % 11 != 0, F.col("species")))
    monkeypatch.setattr(study, "BLOCK", 40)
    made, joined = [], study._pairs
    monkeypatch.setattr(study, "_pairs", lambda *a: made.append(1) or joined(*a))
    count = lambda: sorted(map(repr, study._coded_cube(fitted, rows, 3, 7).select("feature", "repeat", "actual", "predicted", "n").collect()))
    fast = count()
    assert not made
    monkeypatch.setattr(study, "TABLE_CODES", 0)
    assert fast == count() and made


def lines_of(spark, folder, n):
    """``n`` order lines of three kinds."""
    spark.range(n).selectExpr(
        "id AS l_orderkey", "1 AS l_linenumber", "id AS l_partkey", "id AS l_suppkey", "1 + id % 50 + 0.0D AS l_quantity",
        "100.5D + id % 997 AS l_extendedprice", "(id % 11) / 100 AS l_discount", "(id % 9) / 100 AS l_tax",
        "element_at(array('A', 'N', 'R'), cast(id % 3 AS int) + 1) AS l_returnflag", "if(id % 3 = 1, 'O', 'F') AS l_linestatus",
    ).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_batch_scores_learn_from_all_training_rows(spark, tmp_path, monkeypatch):
    from obslab.catalog import models as catalog

    fitted = []
    monkeypatch.setattr(catalog, "WHOLE", replace(catalog.WHOLE, trees=3))
    monkeypatch.setattr(catalog, "fit", lambda *a, **k: fitted.append(fit(*a, **k)) or fitted[-1])
    got = catalog.batch_score(spark, lines_of(spark, tmp_path, 3000))
    assert got.count() == 750 and [m.fitted_rows for m in fitted] == [2250]


def test_large_forests_grow_in_groups_of_trees(toy, fitted, monkeypatch, tmp_path):
    """The trees of separate forests side by side: stored, scored and seen through their bins like any other forest."""
    many = replace(SMALL, trees=5)
    monkeypatch.setattr(models, "GROWN", 600)
    monkeypatch.setattr(models, "GROUP_TREES", 1)
    joined = fit(toy, SPEC, many)
    monkeypatch.undo()
    shown = lambda m: [t.toDebugString() for t in models._trees(m.classifier)]
    text = lambda m: [t.split("\n", 1)[1] for t in shown(m)]
    parts = [fit(toy, SPEC, replace(many, trees=n, seed=many.seed + i * models._SEEDS)) for i, n in enumerate((2, 2, 1))]
    assert text(joined) == [t for p in parts for t in text(p)] and joined.classifier.getNumTrees == 5
    assert joined.fitted_rows == 300 and models.forest_size(joined)["tree_nodes"] >= 3 and accuracy(joined, toy) > 0.95
    joined.save(f"{tmp_path}/model")
    again = FittedModel.load(f"{tmp_path}/model", SPEC, many)
    both = [m.predict(toy).orderBy("row").select("probabilities").collect() for m in (joined, again)]
    assert both[0] == both[1]
    seen = forest_bins.predict(joined, toy).orderBy("row").select("probabilities").collect()
    assert seen == both[0]


def test_cross_validation_metrics_learn_from_all_rows_of_a_fold(spark, tmp_path, monkeypatch):
    from obslab.catalog import models as catalog

    monkeypatch.setattr(catalog, "WHOLE", replace(catalog.WHOLE, trees=3))
    got = catalog.cv_metrics(spark, lines_of(spark, tmp_path, 1000)).collect()
    assert len(got) == 5 and {(r["n_train"], r["n_validation"]) for r in got} == {(600, 150)}


def test_large_whole_forests_of_a_study_grow_one_after_the_other(toy, monkeypatch):
    bounded = replace(SMALL, fit_rows=60)
    assert study._at_once(toy, [SMALL, bounded]) == study.PARALLEL_FITS
    monkeypatch.setattr(study, "GROWN", 900)
    assert [study._at_once(toy, [v]) for v in (SMALL, replace(SMALL, trees=500), bounded)] == [2, 1, study.PARALLEL_FITS]
