"""Fits and iterative jobs: recovery of known parameters, invariants, brute force on small inputs."""

from __future__ import annotations

import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import paths
from wattweave.operators import windows as W
from wattweave.plans import chains, curves, families, interpret, ranking, regimes, segments, selection
from wattweave.spread import ordered_rank, running_sum


def series(n=400, seed=4, users=(1, 2)):
    rng = np.random.default_rng(seed)
    rows = []
    for u in users:
        state = 0
        for i in range(n):
            t = 20 * math.sin(i / 20) + rng.normal()
            state = state if rng.random() < 0.95 else 1 - state
            y = (5 + 0.1 * t + 0.3 * rng.normal()) if state == 0 else (20 + 1.0 * t + 0.5 * rng.normal())
            rows.append((u, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(y), float(t), state + 1))
    return rows


@pytest.fixture(scope="module")
def hours(spark):
    return spark.createDataFrame(series(), "uid long, ts timestamp, obs double, t_d double, truth int").persist()


def test_fit_recovers_regimes_and_decodes_them(spark, hours):
    fits = regimes.fit_regimes(hours, ks=[2]).persist()
    resp = {(r["uid"], r["state"]): r for r in regimes.split_models(fits)["model_response"].collect()}
    for u in (1, 2):
        assert abs(resp[u, 1]["intercept"] - 5) < 0.3 and abs(resp[u, 1]["slope"] - 0.1) < 0.05
        assert abs(resp[u, 2]["intercept"] - 20) < 0.5 and abs(resp[u, 2]["slope"] - 1.0) < 0.05
    out = regimes.decode_states(hours, fits).join(hours.select("uid", "ts", "truth"), ["uid", "ts"])
    told = out.agg(F.avg((F.col("state") == F.col("truth")).cast("double")), F.max(F.abs(F.aggregate("delta", F.lit(0.0), lambda a, x: a + x) - 1)), F.max(F.abs(F.aggregate("gamma", F.lit(0.0), lambda a, x: a + x) - 1))).first()
    assert told[0] > 0.98 and told[1] < 1e-9 and told[2] < 1e-9


def test_one_state_is_least_squares(spark, hours):
    fit = regimes.split_models(regimes.fit_regimes(hours, ks=[1]))["model_response"].orderBy("uid").collect()
    want = hours.groupBy("uid").agg(F.regr_slope("obs", "t_d"), F.regr_intercept("obs", "t_d")).orderBy("uid").collect()
    for a, b in zip(fit, want, strict=True):
        assert abs(a["slope"] - b[1]) < 1e-6 and abs(a["intercept"] - b[2]) < 1e-6


def test_more_states_score_better_and_are_chosen(spark, hours):
    fits = regimes.fit_regimes(hours, ks=[1, 2]).persist()
    scores = regimes.model_scores(fits, hours)
    bic = {(r["uid"], r["k"]): r["bic"] for r in scores.collect()}
    assert all(bic[u, 2] < bic[u, 1] for u in (1, 2))
    assert all(r["p"] < 1e-6 for r in regimes.likelihood_ratio(scores, 1, 2).collect())
    chosen = regimes.select_model_size(hours, 1, 2).where("chosen").collect()
    assert {r["uid"]: r["k"] for r in chosen} == {1: 2, 2: 2}


def test_viterbi_beats_every_path():
    rng = np.random.default_rng(0)
    for _ in range(5):
        log_b, a, pi = rng.normal(size=(5, 2)), rng.dirichlet([1, 1], size=(4, 2)), rng.dirichlet([1, 1])
        path, delta = paths.viterbi(log_b, a, pi)
        score = lambda p: math.log(pi[p[0]]) + sum(log_b[t][s] for t, s in enumerate(p)) + sum(math.log(a[t][p[t]][p[t + 1]]) for t in range(4))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=5), key=score)
        assert abs(score(tuple(path)) - score(best)) < 1e-9 and np.allclose(delta.sum(axis=1), 1)
        total = sum(math.exp(score(p)) for p in itertools.product((0, 1), repeat=5))
        assert abs(paths.forward_backward(log_b, a, pi)[2] - math.log(total)) < 1e-9


def test_mixture_finds_two_levels(spark, hours):
    out = regimes.fit_mixture(hours, 2, iterations=15).orderBy("slope").collect()
    assert abs(out[0]["intercept"] - 5) < 0.5 and abs(out[1]["intercept"] - 20) < 1.0
    counts = spark.createDataFrame([(float(x), 0.0) for x in [1, 2, 1, 0, 2, 30, 28, 33, 31]], "obs double, t_d double")
    assert sorted(round(r["intercept"]) for r in regimes.fit_mixture(counts, 2, family="poisson").collect()) == [1, 30]


def test_stationary_and_propagation(spark):
    p = spark.createDataFrame([(1, h, i, j, v) for h in range(3) for i, row in ((1, (0.9, 0.1)), (2, (0.4, 0.6))) for j, v in enumerate(row, 1)], "uid int, hour int, from int, to int, p double")
    pi = {r["state"]: r["pi"] for r in interpret.stationary_distribution(p.where("hour = 0").withColumn("t", F.lit(0))).collect()}
    assert abs(pi[1] - 0.8) < 1e-9 and abs(pi[2] - 0.2) < 1e-9
    init = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.0)], "uid int, state int, pi double")
    dist = interpret.propagate_state_distribution(init, p)
    got = {r["hour"]: r["dist"] for r in dist.collect()}
    v = np.array([1.0, 0.0])
    for h in range(3):
        v = v @ np.array([[0.9, 0.1], [0.4, 0.6]])
        assert np.allclose(got[h], v)
    resp = spark.createDataFrame([(1, 1, 2.0, 0.5), (1, 2, 10.0, 1.0)], "uid int, state int, slope double, se_slope double")
    m = {r["hour"]: r for r in interpret.profile_moments(dist, resp).collect()}
    assert abs(m[0]["mu"] - (0.9 * 2 + 0.1 * 10)) < 1e-9
    cov = {(r["h1"], r["h2"]): r["cov"] for r in interpret.profile_covariance(dist, p, resp).collect()}
    a, mu, d0 = np.array([[0.9, 0.1], [0.4, 0.6]]), np.array([2.0, 10.0]), np.array([0.9, 0.1])
    assert abs(cov[0, 1] - ((d0 * mu) @ a @ mu - (d0 @ mu) * (d0 @ a @ mu))) < 1e-9
    half = {(r["h1"], r["h2"]): r["cov"] for r in interpret.profile_covariance(dist, p, resp, compat=True).collect()}
    assert abs(half[0, 2] - cov[0, 2] / 2) < 1e-9


def test_breakpoint_is_found(spark):
    rows = [(1, float(t), 3.0 + (0.5 * (t - 60) if t > 60 else -0.2 * (t - 60))) for t in range(30, 100)]
    out = curves.breakpoint_response(spark.createDataFrame(rows, "uid int, t double, y double"), "y", "t", range(40, 90, 5)).first()
    assert out["break_at"] == 60 and abs(out["slope_below"] + 0.2) < 1e-6 and abs(out["slope_above"] - 0.5) < 1e-6


def test_chains_take_the_best_numbering(spark):
    """Statistics of every structure under all numberings, against loops over them; p against the series of the distribution."""
    rng = np.random.default_rng(1)
    rows, s = [], 0
    for i in range(600):  # a ring, numbered backwards
        rows.append((1, i, s + 1))
        s = s if rng.random() < 0.6 else (s - 1) % 3
    counts = chains.transition_counts(spark.createDataFrame(rows, "uid int, ts int, state int"))
    templates = chains.chain_templates(spark, 3)
    assert all(abs(r["s"] - 1) < 1e-9 for r in templates.groupBy("template", "from").agg(F.sum("p").alias("s")).collect())
    p = {}
    for r in templates.collect():
        p.setdefault(r["template"], np.zeros((3, 3)))[r["from"] - 1, r["to"] - 1] = r["p"]
    assert p["fwdjump"].tolist() == [[1 / 3] * 3, [0, 0.5, 0.5], [0.5, 0, 0.5]] and p["telescope"][0].tolist() == [0.5, 0.5, 0]
    n = np.zeros((3, 3))
    for (_, _, a), (_, _, b) in zip(rows, rows[1:], strict=False):
        n[a - 1, b - 1] += 1
    got = {r["template"]: r for r in chains.chain_chi2(counts, templates).collect()}
    lr = {r["template"]: r["lr"] for r in chains.chain_lr(counts, templates).collect()}
    for name, a in p.items():
        stats, ratios = [], []
        for perm in itertools.permutations(range(3)):
            e = n.sum(axis=1, keepdims=True) * np.maximum(a[np.ix_(np.argsort(perm), np.argsort(perm))], 1e-6)
            stats.append(((n - e) ** 2 / e).sum())
            ratios.append(2 * (n[n > 0] * np.log(n[n > 0] / e[n > 0])).sum())
        assert abs(got[name]["chi2"] - min(stats)) < 1e-6 * min(stats) and abs(lr[name] - min(ratios)) < 1e-6 * max(1, min(ratios)) and got[name]["df"] == 6
        x = got[name]["chi2"]
        assert abs(got[name]["p"] - (1 - math.exp(-x / 2) * (1 + x / 2 + x * x / 8))) < 1e-9
    assert chains.chain_type(chains.chain_chi2(counts, templates)).first()["template"] in ("fwdjump", "telescope")
    tails = spark.createDataFrame([(1.0, 1), (3.84145882, 1), (7.8147279, 3), (0.0, 2), (5.99146455, 2)], "x double, df int").select(chains.chi2_tail(F.col("x"), F.col("df")).alias("p")).collect()
    assert np.allclose([r["p"] for r in tails], [0.3173105, 0.05, 0.05, 1.0, 0.05], atol=1e-6)


def test_clusters_with_errors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (np.full(24, c * 10.0) + rng.normal(0, 0.5, 24)).tolist(), [0.25] * 24) for i, c in enumerate([0, 1, 2] * 15)]
    df = spark.createDataFrame(rows, "id int, v array<double>, s array<double>")
    members, centres = segments.kerror_cluster(df, 6)
    told = {r["id"]: r["cluster"] for r in members.collect()}
    assert len(told) == 45 and all(told[i] != told[j] for i, j in ((0, 1), (1, 2), (0, 2)))
    soft, mu = segments.fuzzy_cmeans(df, 3, iterations=6)
    assert all(abs(r[1] - 1) < 1e-9 for r in soft.groupBy("id").agg(F.sum("membership")).collect())
    assert segments.segment_profile(centres, members).where("hour = 0").count() <= 6
    sweep = {r["k"]: r["within_ss"] for r in segments.kmeans_sweep(df, [1, 3]).collect()}
    assert sweep[3] < sweep[1]


def test_kendall_and_drank(spark):
    rows = [(i, float(20 - i), float(20 - i) if i != 3 else 30.0) for i in range(20)]
    out = ranking.kendall_tau_at_k(spark.createDataFrame(rows, "uid int, model double, truth double"), [5, 10]).collect()
    assert {r["k"]: r["n"] for r in out} == {5: 5, 10: 10} and all(-1 <= r["tau"] <= 1 for r in out)
    scores = spark.createDataFrame([(rep, u, float(10 - u) + 0.01 * rep) for rep in range(4) for u in range(10)], "rep int, uid int, score double")
    truth = spark.createDataFrame([(u, u + 1) for u in range(10)], "uid int, rank int")
    assert [r["distance"] for r in ranking.drank(scores, truth, [4, 10], 20).collect()] == [0.0, 0.0]


def test_rank_distance_is_that_of_the_nearest_means_in_order(spark):
    """Against all choices of which neighbours tie."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 4)) + [0.3, 0.1, 0.4, 0.2]
    scores = spark.createDataFrame([(i, u, float(x[i, u])) for i in range(12) for u in range(4)], "rep int, uid int, score double")
    truth = spark.createDataFrame([(u, u + 1) for u in range(4)], "uid int, rank int")
    got = ranking.drank(scores, truth, [4], 30).first()
    d = x[:, :-1] - x[:, 1:]
    m, s1 = d.mean(axis=0), np.linalg.inv(np.cov(d, rowvar=False) + 1e-5 * np.eye(3))
    best = np.inf
    for held in itertools.product((False, True), repeat=3):  # True: this difference is held at zero
        free, fixed = [i for i in range(3) if not held[i]], [i for i in range(3) if held[i]]
        t = np.zeros(3)
        if free:
            shift = np.linalg.solve(s1[np.ix_(free, free)], s1[np.ix_(free, fixed)] @ m[fixed]) if fixed else 0.0
            t[free] = m[free] + shift
        if (t >= -1e-12).all():
            best = min(best, 12 * (t - m) @ s1 @ (t - m))
    assert abs(got["distance"] - math.sqrt(best)) < 1e-6 and 0 <= got["p"] <= 1


def test_ranks_by_ranges(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 4)), float(rng.integers(0, 30)), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, x double, i int").repartition(7)
    want = {i: n for n, (_, _, i) in enumerate(sorted(rows, key=lambda r: (-r[1], r[2])), 1)}
    assert {r["i"]: r["rank"] for r in ordered_rank(df, [F.col("x").desc(), F.col("i")]).collect()} == want
    got = {(r["g"], r["i"]): r["rank"] for r in ordered_rank(df, [F.col("x"), F.col("i")], by=["g"]).collect()}
    for g in range(4):
        assert {i: got[g, i] for q, _, i in rows if q == g} == {i: n for n, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])), 1)}
    assert ordered_rank(df.where("false"), [F.col("x")]).count() == 0


def test_running_sums_by_blocks(spark):
    rng = np.random.default_rng(10)
    rows = [(int(rng.integers(0, 3)), float(rng.integers(0, 20)), float(rng.normal()) if rng.random() > 0.1 else None, i) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, x double, v double, piece int").repartition(5)
    for by in ([], ["g"]):
        placed = ordered_rank(df, [F.col("x"), F.col("piece")], "n", by)
        for block in (1, 7, 1000):
            got = {r["piece"]: r["s"] for r in running_sum(placed, "n", F.col("v"), "s", by, block).collect()}
            for g in range(3) if by else [None]:
                own = sorted((r for r in rows if g is None or r[0] == g), key=lambda r: (r[1], r[3]))
                for want, r in zip(np.cumsum([r[2] or 0.0 for r in own]), own, strict=True):
                    assert abs(got[r[3]] - want) < 1e-9
    assert running_sum(ordered_rank(df.where("false"), [F.col("x")], "n"), "n", F.col("v"), "s").count() == 0


def test_families_are_recovered(spark):
    """Two classes of draws from every family at once."""
    rng = np.random.default_rng(8)
    rows = []
    for c in [0] * 700 + [1] * 300:
        z = rng.multivariate_normal([0, 5] if c == 0 else [8, -2], [[1, 0.5], [0.5, 2]])
        rows.append((float(rng.gamma(4, 0.5 if c == 0 else 3.0)), float(rng.poisson(2 if c == 0 else 12)), float(rng.random() < (0.2 if c == 0 else 0.9)), "xyz"[rng.choice(3, p=[0.7, 0.2, 0.1] if c == 0 else [0.1, 0.2, 0.7])], *map(float, z)))
    df = spark.createDataFrame([*rows, (None, 1.0, 0.0, "x", 0.0, 0.0), (1.0, 1.0, 0.0, "other", 0.0, 0.0)], "g double, n double, b double, c string, u double, v double")
    out = families.fit_families(df, 2, [families.Gamma("g"), families.Poisson("n"), families.Binomial("b"), families.Multinomial("c", ["x", "y", "z"]), families.Normal("u", "v")])
    got = {(r["state"], r["response"], r["parameter"]): r["value"] for r in out.collect()}
    assert abs(out.where("state = 1").first()["weight"] - 0.7) < 0.03
    want = {(1, "n", "mean"): 2, (2, "n", "mean"): 12, (1, "b", "p"): 0.2, (2, "b", "p"): 0.9, (1, "c", "x"): 0.7, (2, "c", "z"): 0.7, (1, "u+v", "mean u"): 0, (2, "u+v", "mean u"): 8, (1, "u+v", "cov v u"): 0.5, (1, "g", "scale"): 0.5}
    for key, value in want.items():
        assert abs(got[key] - value) < 0.15 * max(1, abs(value)), (key, got[key])
    assert abs(got[1, "g", "shape"] - 4) < 0.6 and families.fit_families(df.where("false"), 2, [families.Gamma("g")]).count() == 0


def test_greedy_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    profiles = [(u, rng.uniform(0, 2, 24).tolist(), rng.uniform(0, 0.1, 24).tolist()) for u in range(5)]
    goal, rate = [1.5] * 24, [0.2] * 24
    p = spark.createDataFrame(profiles, "uid int, a array<double>, w array<double>")
    s = selection.square_wave_schedules(spark, [0, 6, 12, 18], 6)
    out = selection.greedy_select(p, s, goal, rate).orderBy("step").collect()
    waves = {r["schedule"]: np.array(r["u"]) for r in s.collect()}

    def cost(chosen):
        d, v = np.zeros(24), np.zeros(24)
        for u, k in chosen:
            d += waves[k] * profiles[u][1]
            v += waves[k] ** 2 * np.array(profiles[u][2])
        return float((np.array(rate) * ((d - goal) ** 2 + v)).sum())

    chosen = []
    for r in out:
        best = min((cost([*chosen, (u, k)]), u, k) for u in range(5) if u not in [c[0] for c in chosen] for k in waves)
        chosen.append((r["uid"], r["schedule"]))
        assert abs(cost(chosen) - best[0]) < 1e-9 and abs(r["cost"] - best[0]) < 1e-6
    assert out and all(a["cost"] > b["cost"] for a, b in zip(out, out[1:], strict=False))


def test_greedy_takes_out_what_no_longer_helps(spark):
    """One user covers all hours coarsely; the users that come after make it a burden."""
    one = lambda hours, a: [a if h in hours else 0.0 for h in range(24)]
    profiles = [(0, [1.3] * 24, [0.0] * 24)] + [(i, one(range(6 * (i - 1), 6 * i), 1.0), [0.0] * 24) for i in range(1, 5)]
    p = spark.createDataFrame(profiles, "uid int, a array<double>, w array<double>")
    s = selection.square_wave_schedules(spark, [0], 24)
    goal, rate = [1.1] * 24, [1.0] * 24
    out = selection.greedy_select(p, s, goal, rate, eps=1e-6).orderBy("step").collect()
    cost = lambda users: sum((sum(profiles[u][1][h] for u in users) - goal[h]) ** 2 for h in range(24))
    users, want, step = [], [], 0
    top = cost([])
    while True:
        now, step = cost(users), step + 1
        least = 1e-6 / max(len(users), 1) ** 2 * (top - now) if users else 0.0
        adds = sorted((cost([*users, u]), u) for u in range(5) if u not in users)
        drops = sorted((cost([x for x in users if x != u]), u) for u in users)
        if adds and now - adds[0][0] > least:
            users.append(adds[0][1])
            want.append((step, adds[0][1], True))
        elif drops and now - drops[0][0] > least:
            users.remove(drops[0][1])
            want.append((step, drops[0][1], False))
        else:
            break
    assert [(r["step"], r["uid"], r["added"]) for r in out] == want
    assert {r["uid"] for r in out if r["kept"]} == set(users) and abs(out[-1]["cost"] - cost(users)) < 1e-9
    swept = selection.budget_sweep(p, [6, 24], [0], goal, rate, eps=1e-6).where("beta = 24").orderBy("step").collect()
    assert [(r["step"], r["uid"], r["added"]) for r in swept] == want


def test_clusters_with_full_covariances(spark):
    """One round against numpy; diagonal covariances give what variances give."""
    rng = np.random.default_rng(9)
    pts = [(i, (np.array([0.0, 8.0, 16.0][i % 3]) + rng.normal(0, 0.5, 4)).tolist(), rng.uniform(0.1, 0.4, 4).tolist()) for i in range(30)]
    plain = spark.createDataFrame(pts, "id int, v array<double>, s array<double>")
    wide = spark.createDataFrame([(i, v, np.diag(s).ravel().tolist()) for i, v, s in pts], "id int, v array<double>, s array<double>")
    a, ca = segments.kerror_cluster(plain, 3)
    b, cb = segments.kerror_cluster(wide, 3, full=True)
    assert {r["id"]: r["cluster"] for r in a.collect()} == {r["id"]: r["cluster"] for r in b.collect()}
    for x, y in zip(ca.orderBy("cluster").collect(), cb.orderBy("cluster").collect(), strict=True):
        assert np.allclose(x["mu"], y["mu"]) and np.allclose(x["se"], y["se"])
    labels, centres = segments.kmeans_labels(plain, 3)
    assert labels.count() == 30 and sum(r["n"] for r in centres.collect()) == 30


def test_effort_keeps_its_budget_and_lowers_cost(spark):
    rng = np.random.default_rng(6)
    p = spark.createDataFrame([(u, rng.uniform(0.5, 2, 24).tolist(), [0.01] * 24) for u in range(6)], "uid int, a array<double>, w array<double>")
    goal, rate = [4.0] * 24, [0.2] * 24
    tou, g = selection.tariff_and_goal_tables(spark, goal)
    tou = tou.withColumn("rate", F.lit(0.2))
    costs = []
    for n in (1, 12):
        out = selection.allocate_effort(p, goal, rate, 5.0, 1.0, n)
        sums = [(sum(r["u"]), min(r["u"]), max(r["u"])) for r in out.collect()]
        assert all(s <= 5.0 + 1e-6 and lo >= -1e-9 and hi <= 1 + 1e-9 for s, lo, hi in sums)
        costs.append(selection.expected_cost(p, out.select("uid", "u"), g, tou).first()["cost"])
    assert costs[1] < costs[0] < 0.2 * 24 * 16


def test_empty_tables(spark, hours):
    none = hours.where("false")
    assert regimes.fit_regimes(none).count() == 0
    assert regimes.fit_mixture(none, 2).count() == 0
    assert W.acf(none, "obs", 3).count() == 0
    assert curves.breakpoint_response(none, "obs", "t_d", [1.0]).count() == 0
