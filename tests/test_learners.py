"""Learners against NumPy: the same folds, weights and penalties, fitted by Newton steps or least squares."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import LinearRegression

from tandem.operators import learning

N = 180


def logistic(x, y, w, penalty):
    """Coefficients, the intercept last. The penalty is on coefficients of features in units of their weighted deviation, not on the intercept."""
    mean = (w @ x) / w.sum()
    unbiased = w.sum() - (w @ w) / w.sum()
    ridge = np.append(penalty * (w @ (x - mean) ** 2) / unbiased, 0.0)
    full, b = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-full @ b))
        slope = full.T @ (w * (p - y)) / w.sum() + ridge * b
        curve = (full * (w * p * (1 - p))[:, None]).T @ full / w.sum() + np.diag(ridge)
        b = b - np.linalg.solve(curve, slope)
    return b


def chance(x, b):
    return 1 / (1 + np.exp(-(np.c_[x, np.ones(len(x))] @ b)))


def softmax(x, y, k, penalty):
    """Chances of k classes for any rows, by gradient steps on features in units of their deviation."""
    mean, spread = x.mean(0), x.std(0, ddof=1)
    full, b = np.c_[(x - mean) / spread, np.ones(len(x))], np.zeros((x.shape[1] + 1, k))
    keep = np.r_[np.full(x.shape[1], penalty), 0.0][:, None]
    of = lambda f: np.exp(f - f.max(1, keepdims=True)) / np.exp(f - f.max(1, keepdims=True)).sum(1, keepdims=True)
    for _ in range(20000):
        b -= 0.5 * (full.T @ (of(full @ b) - np.eye(k)[y]) / len(x) + keep * b)
    return lambda z: of(np.c_[(z - mean) / spread, np.ones(len(z))] @ b)


def out_of_fold(x, y, w, fold, penalty):
    found = np.zeros(len(x))
    for k in np.unique(fold):
        train = (fold != k) & (w > 0) & ~np.isnan(y)
        found[fold == k] = chance(x[fold == k], logistic(x[train], y[train], w[train], penalty))
    return found


def least_squares(x, y, w, fold):
    found = np.zeros(len(x))
    for k in np.unique(fold):
        t, root = fold != k, np.sqrt(w[fold != k])[:, None]
        full = np.c_[x, np.ones(len(x))]
        found[fold == k] = full[fold == k] @ np.linalg.lstsq(full[t] * root, y[t] * root[:, 0], rcond=None)[0]
    return found


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(N, 2)) * (1.0, 3.0)
    y = (x[:, 0] + 0.3 * x[:, 1] + rng.normal(size=N) > 0.4).astype(float)
    hard, fold, family, group = (y == 0) & (rng.random(N) < 0.4), rng.integers(0, 3, N), rng.integers(0, 2, N), rng.integers(0, 40, N)
    act = np.clip(np.floor(x[:, 0] + rng.normal(size=N) + 2), 0, 3).astype(int)
    rows = [(i, int(fold[i]), int(y[i]), int(hard[i]), int(family[i]), int(group[i]), learning.ACTS[act[i]], float(x[i, 0]), float(x[i, 1]), float(2 * x[i, 0] + rng.normal())) for i in range(N)]
    df = spark.createDataFrame(rows, "id long, fold int, y int, hard_negative int, family int, g long, act string, a double, b double, v double").cache()
    return df, x, y, hard, fold, family, group, act, np.array([r[-1] for r in rows])


def by_id(df, *columns):
    return np.array([[r[c] for c in columns] for r in sorted(df.collect(), key=lambda r: r["id"])], float)


def test_cross_fit_with_missing_labels_and_weights_of_0(case):
    df, x, y, _, fold, *_ = case
    known, w = np.where(np.arange(N) % 7 == 0, np.nan, y), (np.arange(N) % 5).astype(float)
    rows = df.selectExpr("*", "IF(id % 7 = 0, NULL, y) AS label", "CAST(id % 5 AS DOUBLE) AS w")
    got = by_id(learning.cross_fit(rows, LogisticRegression(regParam=0.01), ("a", "b"), weight="w"), "score")[:, 0]
    assert np.allclose(got, out_of_fold(x, known, w, fold, 0.01), atol=2e-3)


def test_episode_detector_weighs_listed_and_hard_rows(case):
    df, x, y, hard, fold, *_ = case
    w = np.where(y == 1, 3.0, np.where(hard, 2.0, 1.0))
    got = by_id(learning.fit_episode_detector(df, ("a", "b"), LinearRegression(regParam=0.0)), "score")[:, 0]
    assert np.allclose(got, least_squares(x, y, w, fold), atol=1e-6)


def test_experts_are_mixed_with_the_detector_of_all(case):
    df, x, y, hard, fold, family, *_ = case
    got = by_id(learning.route_experts(df, ("a", "b"), 0.25, LinearRegression(regParam=0.0)), "universal", "routed", "score")
    routed = np.zeros(N)
    for f in (0, 1):
        own = family == f
        routed[own] = out_of_fold(x[own], y[own], np.ones(own.sum()), fold[own], 0.05)
    universal = least_squares(x, y, np.where(y == 1, 3.0, np.where(hard, 2.0, 1.0)), fold)
    assert np.allclose(got, np.c_[universal, routed, 0.75 * universal + 0.25 * routed], atol=2e-3)


def test_value_residual(case):
    df, x, _, _, fold, _, group, _, v = case
    got = {r["g"]: (r["value"], r["highest"], r["n"]) for r in learning.value_residual(df, "v", ("a", "b"), ("g",), LinearRegression(regParam=0.0)).collect()}
    rest = v - least_squares(x, v, np.ones(N), fold)
    assert set(got) == set(group.tolist())
    for g, found in got.items():
        own = rest[group == g]
        assert found == pytest.approx((own.max() + 0.5 * np.maximum(own, 0).mean(), own.max(), len(own)), abs=1e-6)


def test_action_policy_and_family(case):
    df, x, y, _, fold, family, _, act, _ = case
    got = by_id(learning.fit_action_policy(df, ("a", "b"), iterations=200), *(f"q_{a}" for a in learning.ACTS))
    assert np.allclose(got.sum(1), 1.0)
    kind = by_id(learning.fit_family(df.withColumnRenamed("y", "label"), ("a", "b")), "predicted_family")[:, 0]
    for k in range(3):
        t, e = fold != k, fold == k
        assert np.allclose(got[e], softmax(x[t], act[t], 4, 1e-3)(x[e]), atol=5e-3)
        t &= y == 1  # a family is learned from positives only
        two = softmax(x[t], family[t], 2, 0.01)(x[e])
        clear = np.abs(two[:, 0] - two[:, 1]) > 0.01
        assert (kind[e][clear] == two[clear].argmax(1)).all()


def test_gated_bags(case):
    df, x, y, _, fold, _, group, *_ = case
    of_group = {int(g): int(g) % 3 for g in np.unique(group)}
    episodes = df.withColumn("fold", (df.g % 3).cast("int"))
    pairs = episodes.groupBy("g", "fold").agg({"y": "max"}).withColumnRenamed("max(y)", "label")
    got = {r["g"]: r["score"] for r in learning.gated_bag_model(episodes, pairs, ("a", "b"), ("g",)).collect()}
    gate = np.clip(out_of_fold(x, y, np.ones(N), group % 3, 0.05), 1e-6, 1 - 1e-6)
    ids, bags, label = sorted(of_group), [], []
    for g in ids:
        own = group == g
        s = gate[own] / (1 - gate[own])  # softmax of logits
        s = s / s.sum()
        entropy = -(s * np.log(s + 1e-12)).sum() / np.log(own.sum()) if own.sum() > 1 else 0.0
        bags.append([*(s @ x[own]), *x[own].max(0), s.max(), entropy])
        label.append(y[own].max())
    want = out_of_fold(np.array(bags), np.array(label), np.ones(len(ids)), np.array([of_group[g] for g in ids]), 0.01)
    assert np.allclose([got[g] for g in ids], want, atol=1e-2)


def test_seed_expand_and_domain_classifier(case):
    df, x, y, *_ = case
    rows = df.selectExpr("id AS lo", "id AS hi", "fold", "y AS label", "a", "b", "v")
    got = {r["kind"]: r for r in learning.seed_expand(rows, "v", ("a", "b"), 0.2).collect()}
    v = case[-1]
    high, low = np.sort(v)[int(np.ceil(0.8 * N)) - 1], np.sort(v)[int(np.ceil(0.5 * N)) - 1]
    seed = np.where(v > high, 1.0, np.where((v <= low) | (y == 0), 0.0, np.nan))
    score = out_of_fold(x, seed, np.ones(N), case[4], 0.01)
    assert got["seed"]["pairs"] == (seed == 1).sum() and got["seed"]["mean_statistic"] == pytest.approx(v[seed == 1].mean())
    assert got["seed"]["mean_score"] == pytest.approx(score[seed == 1].mean(), abs=2e-3)
    assert sum(r["pairs"] for r in got.values()) == N
    found = learning.domain_classifier(df.where("y = 0"), df.where("y = 1"), ("a", "b")).collect()
    fx, fy, fold = np.array([(r["a"], r["b"]) for r in found]), np.array([float(r["label"]) for r in found]), np.array([r["fold"] for r in found])
    assert np.allclose([r["score"] for r in found], out_of_fold(fx, fy, np.ones(N), fold, 0.01), atol=2e-3)


def test_pair_risk_weighs_classes_and_has_exact_ranks(case):
    df, x, y, _, fold, *_ = case
    rows = df.selectExpr("id", "fold", "IF(id % 7 = 0, NULL, y) AS label", "a", "b")
    known, score = np.arange(N) % 7 != 0, np.zeros(N)
    for k in range(3):
        train = (fold != k) & known
        w = np.where(y == 1, 0.5 / y[train].mean(), 0.5 / (1 - y[train].mean()))
        score[fold == k] = chance(x[fold == k], logistic(x[train], y[train], w[train], 0.01))
    got = by_id(learning.fit_pair_risk(rows, ("a", "b"), ()), "risk")[:, 0]  # of no seeds: the logistic model alone
    rank = (score[:, None] >= score[None, :]).sum(1) / N
    assert sorted(np.round(got * N, 6)) == list(range(1, N + 1))  # all values differ, and so do their ranks
    assert np.abs(got - rank).max() <= 2.5 / N


@pytest.mark.parametrize("slot", [3, 1000])
def test_equal_scores_share_their_mean_rank(spark, slot):
    values = [0.5] * 5 + [0.1, 0.9, 0.9] + [0.2] * 4
    rows = spark.createDataFrame([(i, v, float(i)) for i, v in enumerate(values)], "id long, s double, t double")
    got = by_id(learning.exact_ranks(rows, {"s": "rs", "t": "rt"}, slot), "rs", "rt")
    below, same = (np.array([sum(f(v, o) for o in values) for v in values]) for f in (lambda v, o: o < v, lambda v, o: o == v))
    assert np.allclose(got, np.c_[(below + (same + 1) / 2) / 12, (np.arange(12) + 1) / 12])


def test_query_of_pair_risk_sees_all_blocks_and_no_smaller_models(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(learning, "_table", lambda name, spark, folder: name)
    monkeypatch.setattr(learning, "fit_pair_risk", lambda *given, **more: seen.append((given, more)) or spark.range(1).selectExpr("1 AS pool", "1 AS lo", "1 AS hi", "1 AS label", "1 AS fold", "1 AS risk"))
    learning.QUERIES["fit_pair_risk"](spark, "")
    ((given, more),) = seen
    assert given[0] == "risk_table" and set(given[1]) == {*learning._PAIR, *learning._BLOCKS} and len(given) == 2 and not more


def test_only_features_that_lack_values_are_filled(case, monkeypatch):
    df, x, y, _, fold, *_ = case
    filled, imputer = [], learning.Imputer
    monkeypatch.setattr(learning, "Imputer", lambda **given: filled.append(given["inputCols"]) or imputer(**given))
    rows = df.selectExpr("id", "fold", "y AS label", "a", "IF(id % 9 = 0, NULL, b) AS b")
    model = LogisticRegression(regParam=0.01)
    whole = by_id(learning.cross_fit(df.withColumnRenamed("y", "label"), model, ("a", "b"), standardize=True), "score")[:, 0]
    assert filled == [] and np.allclose(whole, out_of_fold(x, y, np.ones(N), fold, 0.01), atol=2e-3)
    got = by_id(learning.cross_fit(rows, model, ("a", "b")), "score")[:, 0]
    assert filled == [["b"]] * 3
    gaps = np.arange(N) % 9 == 0
    for k in range(3):
        train = fold != k
        own = np.c_[x[:, 0], np.where(gaps, np.sort(x[train & ~gaps, 1])[(train & ~gaps).sum() // 2], x[:, 1])]
        assert np.allclose(got[fold == k], chance(own, logistic(own[train], y[train], np.ones(train.sum()), 0.01))[fold == k], atol=2e-2)
