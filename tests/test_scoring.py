import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from epigrain.operators import diagnostics, scoring, selection, single_receptor, trees

OPTIONS = dict(seeds=(1, 2), n_trees=6)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 6))
    y = x[:, 0] + 0.5 * x[:, 1] + 0.2 * rng.normal(size=600) > 0.4
    x[:, 5] = x[:, 0] * 2 + 1
    features = spark.createDataFrame(
        [(f"P{i}", *map(float, row)) for i, row in enumerate(x)], "peptide string, " + ", ".join(f"f{j} double" for j in range(6))
    )
    metadata = spark.createDataFrame(
        [(f"P{i}", "Positive" if v else "Negative", f"C{i // 2}") for i, v in enumerate(y)],
        "peptide string, immunogenicity string, cluster string",
    )
    return features, metadata


@pytest.fixture(scope="module")
def trained(labelled):
    features, metadata = labelled
    return scoring.train_models(features, metadata.drop("cluster"), **OPTIONS)


def test_folds_are_near_equal(spark):
    df = spark.createDataFrame([(f"P{i}",) for i in range(23)], "peptide string")
    sizes = {r["fold"]: r["count"] for r in scoring.kfold_assign(df, 1).groupBy("fold").count().collect()}
    assert sizes == {1: 5, 2: 5, 3: 5, 4: 4, 5: 4}


def test_out_of_fold_scores(labelled, trained):
    _, metadata = labelled
    forest, table = trained
    scores = scoring.internal_scores(forest, table)
    assert scores.count() == 1200 and scores.groupBy("peptide", "seed").count().where("count <> 1").count() == 0
    assert scores.where("immunogenicity_score < 0 or immunogenicity_score > 1").count() == 0
    summary = scoring.summarize_scores(scores).join(metadata, "peptide").withColumn("group", F.lit("all"))
    auc = diagnostics.auc_delong(summary, "immunogenicity", "immunogenicity_score").first()
    assert auc["auc"] > 85 and auc["ci_lo"] < auc["auc"] < auc["ci_up"]


def node_rows(forest):
    return {(r.tree, r.node): (r.feature, r.cut, r.left, r.right, r.prob) for r in forest.nodes.collect()}


def plain_walk(nodes, root, tree, x):
    """The leaf that a row reaches."""
    node = root
    while nodes[tree, node][0] >= 0:
        feature, cut, left, right, _ = nodes[tree, node]
        node = left if x[feature] < cut else right
    return node


def test_hashes_are_those_of_the_engine(spark):
    values = [0, 1, -1, 7, 2**62, -(2**63)]
    df = spark.createDataFrame([(a, b) for a in values for b in values], "a long, b long")
    rows = df.select("a", "b", F.xxhash64("a", "b").alias("h")).collect()
    got = trees.hash_longs(np.array([r.a for r in rows]), np.array([r.b for r in rows]))
    assert got.tolist() == [r.h for r in rows]


def test_training_is_repeatable_and_storable(spark, labelled, trained, tmp_path):
    features, metadata = labelled
    forest, table = trained
    again, _ = scoring.train_models(features, metadata.drop("cluster"), **OPTIONS)
    assert node_rows(forest) == node_rows(again)
    forest.save(str(tmp_path / "forest"))
    loaded = scoring.Forest.load(spark, str(tmp_path / "forest"))
    assert loaded.models == forest.models and loaded.features == forest.features
    want = {r.peptide: r.scores for r in trees.model_scores(forest, table, ["peptide"]).collect()}
    assert want == {r.peptide: r.scores for r in trees.model_scores(loaded, table, ["peptide"]).collect()}


def test_levels_and_tasks_grow_the_same_trees(labelled, trained, monkeypatch):
    features, metadata = labelled
    with_gaps = features.withColumn("f3", F.when(F.col("f3") > 1.2, None).otherwise(F.col("f3"))).limit(150)
    options = dict(seeds=(3,), n_trees=2)
    few, _ = scoring.train_models(with_gaps, metadata.drop("cluster"), **options)
    monkeypatch.setattr(trees, "TASK_CELLS", 0)
    many, _ = scoring.train_models(with_gaps, metadata.drop("cluster"), **options)
    assert node_rows(few) == node_rows(many) and len(node_rows(few)) > 100
    stopped, _ = scoring.train_models(with_gaps, metadata.drop("cluster"), max_depth=1, **options)
    assert len(node_rows(stopped)) == 30


def test_scores_are_those_of_a_plain_walk(labelled, trained, monkeypatch):
    forest, table = trained
    nodes, root = node_rows(forest), trees.roots(forest.models, forest.trees)
    monkeypatch.setattr(trees, "BLOCK_NODES", 500)
    monkeypatch.setattr(trees, "BLOCK_ROWS", 100)
    got = {r.peptide: r.scores for r in trees.model_scores(forest, table, ["peptide"]).collect()}
    for r in table.limit(25).collect():
        probs = [nodes[t, plain_walk(nodes, int(root[t]), t, r.features)][4] for t in range(forest.n_trees)]
        assert got[r.peptide] == pytest.approx(np.reshape(probs, (-1, forest.trees)).mean(axis=1).tolist())
    folds = {r.peptide: r.folds for r in table.collect()}
    for r in scoring.internal_scores(forest, table).collect():
        s = (1, 2).index(r.seed)
        assert r.fold == folds[r.peptide][s] and r.immunogenicity_score == pytest.approx(got[r.peptide][5 * s + r.fold - 1])


def test_held_out_rows_do_not_shape_their_own_model(trained):
    forest, table = trained
    rows, nodes = table.collect(), node_rows(forest)
    root = trees.roots(forest.models, forest.trees)
    weights = scoring._model_weights(table, (1, 2))
    for t in (0, 17, 40):
        model = t // forest.trees
        seed_index, fold = divmod(model, 5)
        inside = [r for r in rows if r["folds"][seed_index] != fold + 1]
        sums = {}
        for r in inside:
            leaf = plain_walk(nodes, int(root[t]), t, r["features"])
            sums.setdefault(leaf, np.zeros(2))[r["label"]] += weights[model, r["label"]]
        assert len(sums) > 10
        for leaf, w in sums.items():
            assert nodes[t, leaf][4] == pytest.approx(w[1] / w.sum())
        assert {n for (k, n), v in nodes.items() if k == t and v[0] < 0} == set(sums)


def test_external_prediction(labelled, trained):
    features, _ = labelled
    forest, table = trained
    out = scoring.predict_external(forest, features.withColumn("data", F.lit(1)), "data")
    assert out.count() == 600 and out.columns[:2] == ["data", "peptide"]
    assert scoring.training_overlap(table, features).first()[0] == 600


def test_single_score_has_no_variation(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.2), ("b", 0.4)], "peptide string, immunogenicity_score double")
    got = {r["peptide"]: r["immunogenicity_score_cv"] for r in scoring.summarize_scores(df).collect()}
    assert got["a"] is None and got["b"] == pytest.approx(np.std([0.2, 0.4], ddof=1) / 0.3)


def test_cluster_scores(labelled):
    features, metadata = labelled
    clusters = metadata.select("peptide", "cluster")
    assert scoring.cluster_sample(clusters, 1).count() == 300
    out = scoring.immunogenicity_score_cluster(features, metadata.drop("cluster"), clusters, seeds=(1, 2), n_trees=2)
    got = {r.peptide: r for r in out.collect()}
    drawn = [{r.peptide for r in scoring.cluster_sample(clusters, s).collect()} for s in (1, 2)]
    assert set(got) == drawn[0] | drawn[1]
    assert all((r.immunogenicity_score_cv is None) == (p not in drawn[0] & drawn[1]) for p, r in got.items() if r.immunogenicity_score > 0)
    # one seed alone gives the scores that it adds to both
    alone = scoring.immunogenicity_score_cluster(features, metadata.drop("cluster"), clusters, seeds=(1,), n_trees=2)
    only = drawn[0] - drawn[1]
    assert {r.peptide: r.immunogenicity_score for r in alone.collect() if r.peptide in only} == {p: got[p].immunogenicity_score for p in only}


def test_split_and_scaling(labelled):
    features, metadata = labelled
    prepared = selection.preprocess(features, metadata, 3)
    assert prepared.dt.count() == 300 and prepared.dt.select("cluster").distinct().count() == 300
    for r in prepared.dt.groupBy("immunogenicity").agg(
        F.count_if(F.col("data_type") == "Train").alias("t"), F.count("*").alias("n")
    ).collect():
        assert r["t"] == int(np.ceil(r["n"] * 0.8))
    row = prepared.train().agg(F.avg("f0"), F.stddev_samp("f0")).first()
    assert row[0] == pytest.approx(0, abs=1e-9) and row[1] == pytest.approx(1)
    legacy = selection.preprocess(features.where("f0 > 0"), metadata, 3, legacy_split=True)
    assert legacy.dt.count() == 600 and legacy.dt.where("f0 is null").count() > 0


def test_minor_class_represents_its_cluster(spark):
    rows = [("a", "Positive", "1"), ("b", "Negative", "1"), ("c", "Positive", "2"), ("d", "Positive", "3")]
    metadata = spark.createDataFrame(rows, "peptide string, immunogenicity string, cluster string")
    assert {r["peptide"] for r in selection.cluster_representative(metadata, 1).collect()} == {"b", "c", "d"}


def test_correlation_filter(labelled):
    features, metadata = labelled
    prepared = selection.preprocess(features, metadata, 3)
    filtered = selection.cor_filter(prepared, 0.75)
    assert len(filtered.removed) == 1 and filtered.removed[0] in ("f0", "f5")
    m = selection.correlation_matrix(features, ["f0", "f1", "f5"])
    assert m[0, 2] == pytest.approx(1.0) and np.allclose(m, m.T)


def test_importance_and_sets(labelled):
    features, metadata = labelled
    prepared = selection.preprocess(features.drop("f5"), metadata, 3)
    ranked = selection.importance(prepared, 3, top=2, n_trees=10)
    assert ranked.importance[0] == ("f0", 1.0) and len(ranked.features) == 2
    assert selection.importance_reduce(ranked, 1).features == ["f0"]
    assert selection.combine_sets([["b", "a"], ["a", "b", "c"]]) == ["b", "a"]
    assert selection.combine_sets([["b"], ["a"]], "union") == ["b", "a"]
    with pytest.raises(ValueError):
        selection.combine_sets([["a"]], "except")
    runs = {("Weighted", "10000", 1): prepared}
    assert selection.extract_parameters(runs)["libraries"] == ["Weighted"]


def test_regressions_match_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 3))
    y = 2 + 3 * x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=80)
    df = spark.createDataFrame(
        [(float(v), *map(float, r)) for v, r in zip(y, x)], "delta_g double, sCPP_A_Mean_3 double, sCPP_A_SD_3 double, sCPP_B_SD_4 double"
    )
    names = df.columns[1:]
    full = single_receptor.fit_linear(df, "delta_g", names, stepwise=False)
    want = np.linalg.lstsq(np.column_stack([np.ones(80), x]), y, rcond=None)[0]
    assert [full.intercept, *full.coefficients] == pytest.approx(want.tolist())
    corr = np.corrcoef(x.T)
    assert list(full.vif.values()) == pytest.approx(np.diag(np.linalg.inv(corr)).tolist())
    step = single_receptor.fit_linear(df, "delta_g", names)
    assert step.variables == names[:2] and step.adj_r_sq > 0.99 and step.p_value < 1e-50
    uni = {r["feature"]: r for r in single_receptor.univariate_regression(df, "delta_g", names).collect()}
    r2 = np.corrcoef(x[:, 0], y)[0, 1] ** 2
    assert uni[names[0]]["adj_r_sq"] == pytest.approx(1 - (1 - r2) * 79 / 78)
    picked = single_receptor.univariate_select(
        single_receptor.univariate_regression(df, "delta_g", names), ["A", "B"]
    ).collect()
    assert [r["feature"] for r in picked][0] == names[0] and len({r["aaindex_id"] for r in picked}) == len(picked)
    points, fit = single_receptor.univariate_plot_data(df, "delta_g", names[0], df.limit(2))
    assert points.where("outlier").count() == 2 and fit.count() == 1
    predicted = single_receptor.multivariate_prediction(df, "delta_g", names)
    assert predicted.agg(F.corr("prediction", "delta_g")).first()[0] > 0.99


def test_footprint(spark):
    df = spark.createDataFrame([("1|2|1",), ("1|0|0|0|0|1",), ("a|b",), (None,)], "weights string")
    row = single_receptor.contact_footprint(df).first()
    assert row["within_1"] == pytest.approx(4 / 6 * 100) and row["beyond_2"] == pytest.approx(2 / 6 * 100)
    density = single_receptor.footprint_density(df, points=256).orderBy("point").collect()
    area = np.trapezoid([r["y"] for r in density], [r["x"] for r in density])
    assert len(density) == 256 and area == pytest.approx(1, abs=0.01)


def test_auc_by_hand(spark):
    rows = [("Positive", 0.9), ("Positive", 0.6), ("Positive", 0.4), ("Negative", 0.6), ("Negative", 0.3), ("Negative", 0.1)]
    df = spark.createDataFrame(rows, "truth string, prob double").withColumn("group", F.lit("g"))
    v10 = np.array([1.0, 2.5 / 3, 2 / 3])
    v01 = np.array([1.5 / 3, 1.0, 1.0])
    se = np.sqrt(v10.var(ddof=1) / 3 + v01.var(ddof=1) / 3)
    r = diagnostics.auc_delong(df).first()
    assert r["auc"] == pytest.approx(v10.mean() * 100)
    assert r["ci_lo"] == pytest.approx(max(v10.mean() - 1.959964 * se, 0) * 100, abs=1e-3) and r["ci_up"] == 100.0
    flipped = diagnostics.auc_delong(df.withColumn("prob", -F.col("prob"))).first()
    assert flipped["auc"] == pytest.approx(r["auc"])
    out = diagnostics.classifier_diagnostics(df)
    assert set(out) == {"ROC", "AUC", "PRC", "Calibration", "CumGain", "CumGainLevel"}
    assert out["AUC"].first()["label"].startswith("AUC: 83.3%") and out["Calibration"].count() == 10


def test_held_out_labels_do_not_pick_features(spark, monkeypatch):
    """A feature that holds the labels of the first fold's held-out rows, and nothing else, is not picked for that fold."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(90, 2))
    label = x[:, 0] > 0
    ids = spark.createDataFrame([(f"P{i}",) for i in range(90)], "peptide string")
    first = {r.peptide for r in scoring.kfold_assign(ids, 1, folds=3).where("fold = 1").collect()}
    rows = [
        (f"P{i}", "Positive" if v else "Negative", *map(float, x[i]), (1.0 if v else -1.0) if f"P{i}" in first else 0.0)
        for i, v in enumerate(label)
    ]
    train = spark.createDataFrame(rows, "peptide string, immunogenicity string, f0 double, f1 double, held double")
    used = []
    monkeypatch.setattr(selection, "_kappa", lambda rest, held, names, *_: used.append((rest.join(held, "peptide").count(), list(names))) or 0.5)
    assert selection._cv_kappas(train, ["f0", "f1", "held"], (None, 1), 1, 3, 5) == {None: 0.5, 1: 0.5}
    assert [n for n, _ in used] == [0] * 6 and all(names[0] == "f0" for _, names in used)
    assert "held" not in used[0][1] and "held" in used[2][1]
    assert "held" in selection._differing(train, ["f0", "f1", "held"])


def test_scores_of_the_growing_tasks_are_those_of_the_node_table(labelled, trained):
    features, metadata = labelled
    forest, table = trained
    want = {(r.peptide, r.seed): (r.fold, r.immunogenicity_score) for r in scoring.internal_scores(forest, table).collect()}
    got = scoring.out_of_fold_scores(features, metadata.drop("cluster"), **OPTIONS).collect()
    assert len(got) == len(want) == 1200
    for r in got:
        fold, score = want[r.peptide, r.seed]
        assert r.fold == fold and r.immunogenicity_score == pytest.approx(score)


def test_rows_are_not_repeated_for_every_block_of_trees(spark, labelled, trained, monkeypatch):
    """Scoring sends few rows once: no join or broadcast holds a copy of them for each block, and nodes are not packed into values."""
    forest, table = trained
    monkeypatch.setattr(trees, "BLOCK_NODES", 300)
    plan = trees.model_sums(forest, table, ["peptide"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and "binary" not in plan


def test_slices_of_many_rows_score_as_few_rows_do(labelled, trained, monkeypatch):
    forest, table = trained
    rows = table.unionByName(table.limit(1))  # a repeated key stays a row of its own
    want = sorted((r.peptide, r.scores) for r in trees.model_scores(forest, rows, ["peptide"]).collect())
    monkeypatch.setattr(trees, "TASK_CELLS", 1000)
    monkeypatch.setattr(trees, "BLOCK_NODES", 500)
    got = sorted((r.peptide, r.scores) for r in trees.model_scores(forest, rows, ["peptide"]).collect())
    assert len(got) == len(want) == 601
    assert all(p == q and a == pytest.approx(b) for (p, a), (q, b) in zip(got, want))


def test_two_nodes_of_one_name_are_refused():
    one = [np.zeros(2, np.int32), np.array([7, 7]), np.full(2, -1), np.zeros(2), np.full(2, 0.5)]
    with pytest.raises(ValueError, match="same hash"):
        trees._Walk(*one, 1)


def test_trees_stored_while_they_grow(spark, labelled, trained, tmp_path):
    features, metadata = labelled
    stored, _ = scoring.train_models(features, metadata.drop("cluster"), path=str(tmp_path / "grown"), **OPTIONS)
    assert node_rows(stored) == node_rows(trained[0])


def test_density_reads_footprints_once_and_counts_repeats(spark, monkeypatch):
    rows = [("1|2|1",)] * 3 + [("1|0|0|0|0|1",), ("a|b",), (None,), ("2.7|1",), ("2.7|1",)]
    df = spark.createDataFrame(rows, "weights string")
    apart = []
    sites = single_receptor.footprint_sites
    monkeypatch.setattr(single_receptor, "footprint_sites", lambda d, *a: apart.append(d.count()) or sites(d, *a))
    reads, stage = [], single_receptor.stage
    monkeypatch.setattr(single_receptor, "stage", lambda d: reads.append(1) or stage(d))
    density = single_receptor.footprint_density(df, points=64).orderBy("point").collect()
    assert apart == [5] and reads == [1]
    want = sites(df).groupBy("position").agg(F.sum("copies").alias("n")).toPandas()
    x, n = want["position"].to_numpy(float), want["n"].to_numpy(float)
    flat = np.sort(np.repeat(x, n.astype(int)))
    q = np.quantile(flat, [0.25, 0.75])
    h = 0.9 * min(flat.std(ddof=1), (q[1] - q[0]) / 1.34) * len(flat) ** -0.2
    for r in density[::9]:
        y = (n * np.exp(-0.5 * ((r.x - x) / h) ** 2)).sum() / (len(flat) * h * np.sqrt(2 * np.pi))
        assert r.y == pytest.approx(y)


def test_growing_holds_one_value_per_row_at_a_time():
    rng = np.random.default_rng(4)
    x, label, rows = rng.random((60_000, 6)), (rng.random(60_000) < 0.4).astype(np.int64), np.arange(60_000)

    def peak(tries):
        tracemalloc.start()
        for _ in trees.grow_block(x, label, [rows], np.array([0]), trees.roots([(1, 1)], 1), np.ones((1, 2)), tries, 3):
            pass
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(6) < 1.1 * peak(1)


def test_prepared_rows_are_written_once_for_every_later_step(spark):
    rows = [(f"p{i}", "Positive" if i % 3 else "Negative", f"c{i}", float(i), float(i % 7)) for i in range(40)]
    table = spark.createDataFrame(rows, "peptide string, immunogenicity string, cluster string, a double, b double")
    prepared = selection.preprocess(table.select("peptide", "a", "b"), table.select("peptide", "immunogenicity", "cluster"), 3)
    assert "Join" not in prepared.dt._jdf.queryExecution().toString()
    assert prepared.dt.count() == 40


def test_a_task_leaves_one_row_per_model_and_held_out_peptide(spark, labelled, trained, monkeypatch):
    """However many blocks of trees a task grows: else what is shuffled grows with the square of the rows."""
    features, metadata = labelled
    table, names, models, weights, tries = scoring._weighed(features, metadata.drop("cluster"), None, (1, 2), None, 5)
    left, in_tasks = [], trees._in_tasks

    def counted(*args):
        left.append(in_tasks(*args))
        return left[-1]

    monkeypatch.setattr(trees, "_in_tasks", counted)
    monkeypatch.setattr(trees, "TASK_ROWS", 600)  # a tree at a time
    scores = trees.held_out_scores(table, models, weights, 20, tries, None, scoring.N_FOLDS)
    assert scores.count() == 1200
    most = 1200 + 120 * left[0].rdd.getNumPartitions()
    assert left[0].rdd.getNumPartitions() < 200 and left[0].count() <= most < 1200 * 20


@pytest.mark.parametrize("cells", [trees.TASK_CELLS, 1000])
def test_more_nodes_are_dealt_to_more_tasks(spark, labelled, trained, monkeypatch, cells):
    """A scoring task sorts the nodes it gets, so the session's number of partitions must not fix their number."""
    forest, table = trained
    monkeypatch.setattr(trees, "BLOCK_NODES", 300)
    monkeypatch.setattr(trees, "TASK_CELLS", cells)
    blocks = trees._tree_blocks(forest, 300 if cells > 1000 else 1500)[1]
    plan = trees.model_sums(forest, table, ["peptide"])._jdf.queryExecution().toString()
    dealt = [int(n) for n in re.findall(r"RepartitionByExpression \[block#\d+(?:, slice#\d+)?\], (\d+)", plan)]
    assert dealt and min(dealt) >= max(blocks / 2, 9)  # the session has 8
    assert not re.findall(r"Exchange hashpartitioning\(block#\d+(?:, slice#\d+)?, \d+\), ENSURE", plan)


def test_single_precision_that_is_exact_gives_the_same_nodes(spark, labelled):
    """Tables that it holds are collected, sent and grown with half the space."""
    rng = np.random.default_rng(21)
    x = rng.normal(size=(3000, 7)).astype(np.float32)
    x[:, 3] = np.round(x[:, 3])
    x[rng.random(x.shape) < 0.02] = np.nan
    label, taken = (rng.random(3000) < 0.4).astype(np.int64), [np.arange(3000), np.arange(0, 3000, 2)]

    def grown(values):
        return [np.concatenate(c) for c in zip(*trees.grow_block(values, label, taken, np.arange(2), trees.roots([(1, 1)], 2), np.ones((2, 2)), 5))]

    for single, double in zip(grown(np.asfortranarray(x)), grown(np.asfortranarray(x, float))):
        assert single.dtype == double.dtype and np.array_equal(single, double)
    rows = [(f"P{i}", i % 2, [float(v) if v == v else None for v in row], [1 + i % 5]) for i, row in enumerate(x[:200])]
    table = spark.createDataFrame(rows, "peptide string, label int, features array<double>, folds array<int>")
    args = ([(1, k) for k in range(1, 6)], np.ones((5, 2)), 3, 5, None, 5)
    assert trees.narrow(table).schema["features"].dataType.elementType.simpleString() == "float"
    more = table.unionByName(spark.createDataFrame([("Q", 1, [0.1] * 7, [0])], table.schema))  # no seed drew it
    assert trees.narrow(more).schema["features"].dataType.elementType.simpleString() == "double"
    small, wide = (sorted(map(tuple, trees.grow(t, 7, *args).collect())) for t in (table, more))
    assert small == wide


def test_stored_trees_take_less_than_a_byte_per_node_and_come_back_whole(spark, labelled, tmp_path):
    features, metadata = labelled
    noise = features.select("peptide", *[F.rand(j).cast("float").cast("double").alias(f"f{j}") for j in range(3)])
    labels = metadata.select("peptide", F.when(F.xxhash64("peptide") % 2 == 0, "Positive").otherwise("Negative").alias("immunogenicity"))
    with_gaps = trees.stage(noise.withColumn("f1", F.when(F.col("f1") > 0.9, None).otherwise(F.col("f1"))))
    for depth in (None, 3):
        options = dict(seeds=(1,), n_trees=60, max_depth=depth)
        kept, table = scoring.train_models(with_gaps, labels, **options)
        stored, _ = scoring.train_models(with_gaps, labels, path=str(tmp_path / f"forest{depth}"), **options)
        nodes = node_rows(kept)
        assert node_rows(stored) == nodes and len({t for t, _ in nodes}) == 300
        size = sum(p.stat().st_size for p in (tmp_path / f"forest{depth}").rglob("*.parquet"))
        assert depth or size < len(nodes)
        want = {(r.peptide, r.fold): r.immunogenicity_score for r in scoring.internal_scores(kept, table).collect()}
        got = {(r.peptide, r.fold): r.immunogenicity_score for r in scoring.internal_scores(stored, table).collect()}
        assert got == {k: pytest.approx(v) for k, v in want.items()} and len(got) == 600


def test_stored_trees_are_walked_where_they_are_worked_out(spark, labelled, tmp_path, monkeypatch):
    """No node is moved, however many rows are scored; those are read some at a time."""
    features, metadata = labelled
    stored, table = scoring.train_models(features, metadata.drop("cluster"), path=str(tmp_path / "forest"), **OPTIONS)
    twice = table.unionByName(table.limit(1))  # a repeated key stays a row of its own
    want = sorted((r.peptide, r.scores) for r in trees.model_scores(trees.Forest(trees.stage(stored.nodes), *named(stored)), twice, ["peptide"]).collect())
    monkeypatch.setattr(trees, "FILE_CELLS", 1000)
    monkeypatch.setattr(trees, "TASK_CELLS", 100)
    sums = trees.model_sums(stored, twice, ["peptide"])
    plan = sums._jdf.queryExecution().toString()
    assert "feature#" not in plan and "cut#" not in plan
    got = sorted((r.peptide, r.scores) for r in trees.model_scores(stored, twice, ["peptide"]).collect())
    assert len(got) == 601 and all(p == q and a == pytest.approx(b) for (p, a), (q, b) in zip(got, want))


def named(forest):
    return forest.features, forest.models, forest.trees


def test_cuts_of_other_trees_are_refused():
    rng = np.random.default_rng(5)
    x, label, args = rng.random((50, 3)), np.arange(50) % 2, ([np.arange(50)], np.array([0]), trees.roots([(1, 1)], 1), np.ones((1, 2)), 2)
    noted = []
    whole = list(trees.grow_block(x, label, *args, noted=noted))
    packed = trees.zlib.compress(np.concatenate(noted).astype(np.uint8).tobytes())
    for a, b in zip(whole, trees.grow_block(x, label, *args, told=packed), strict=True):
        assert all(np.array_equal(p, q) for p, q in zip(a, b, strict=True))
    with pytest.raises(ValueError, match="not those of these trees"):
        list(trees.grow_block(x, label, *args, told=trees.zlib.compress(b"\0")))


def test_a_table_that_is_too_large_to_send_is_read_by_the_tasks(labelled, monkeypatch):
    """Growing by levels writes a row per vector and tree at every level."""
    features, metadata = labelled
    labels, clusters = metadata.drop("cluster"), metadata.select("peptide", "cluster")

    def scores():
        frames = scoring.immunogenicity_score(features, labels, **OPTIONS), scoring.immunogenicity_score_cluster(features, labels, clusters, **OPTIONS)
        return [{r.peptide: r.immunogenicity_score for r in f.collect()} for f in frames]

    want = scores()
    monkeypatch.setattr(trees, "TASK_CELLS", 600 * 6 // 8)
    monkeypatch.setattr(trees, "_grow_by_levels", lambda *_: pytest.fail("grown by levels"))
    for a, b in zip(want, scores(), strict=True):
        assert b == {k: pytest.approx(v) for k, v in a.items()} and len(b) >= 300
