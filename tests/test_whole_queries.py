import itertools
import os

import numpy as np
import pytest

from temporalis.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def run(spark, name):
    return queries.ALL[name][0](queries.Frames(spark, SF)).collect()


def test_whole_picks_equal_plain_loops(spark):
    f = queries.Frames(spark, SF)
    rep = {(r.formula_id, r.target): (r.sign, r.delta) for r in f.rep().collect()}
    rho, label, split = {}, {}, {}
    for r in f.feat().collect():
        rho[r.series_id, r.formula_id], label[r.series_id], split[r.series_id] = r.rho, r.label, r.split
    train, test = ([s for s in split if split[s] == x] for x in ("TRAIN", "TEST"))
    on = lambda s, j, t: rep[j, t][0] * rho[s, j] + rep[j, t][1] > 0
    holds = {(j, t): {x for x in train if on(x, j, t)} for j, t in rep}
    pools: dict = {}
    for r in f.pool().collect():
        pools.setdefault((r.series_id, r.target), []).append((r.rank, r.formula_id))
    first: dict = {}
    quality: dict = {}
    for (s, t), pool in sorted(pools.items()):
        picks, best = [], -1.0
        while best < queries.LIMIT and len(picks) < len(pool):
            options = []
            for rank, j in pool:
                if j not in picks:
                    hit = set.intersection(*(holds[k, t] for k in [*picks, j]))
                    tp = sum(label[x] == t for x in hit)
                    options.append((-(tp / len(hit) if hit else 0.0), rank, j, tp))
            low, _, j, tp = min(options)
            best = -low
            picks.append(j)
        first.setdefault((t, tuple(sorted(picks))), s)
        quality[t, tuple(sorted(picks)), round(best, 6), tp] = None
    assert max(len(p) for _, p in first) > 1
    assert {(r.target, tuple(map(int, r.picks.split(",")))): r.first_id for r in run(spark, "distinct_locals_whole")} == first
    assert {(r.target, tuple(map(int, r.picks.split(","))), r.precision, r.n_tp) for r in run(spark, "local_quality_whole")} == set(quality)
    f1 = {}
    for r in run(spark, "global_f1_whole"):
        hit = [x for x in test if any(all(on(x, j, r.target) for j in p) for t, p in first if t == r.target)]
        tp, own = sum(label[x] == r.target for x in hit), sum(label[x] == r.target for x in test)
        assert (r.n_pos, r.tp, r.n_class) == (len(hit), tp, own)
        f1[r.target] = r.f1
        assert r.f1 is None and not tp or r.f1 == pytest.approx(2 * tp / (len(hit) + own), abs=2e-6)
    assert set(f1) == {t for t, _ in first}
    known = [x for x in f1.values() if x is not None]
    assert run(spark, "global_macro_whole")[0].macro_f1 == pytest.approx(sum(known) / len(known), abs=2e-6)


def test_whole_abduction_equals_all_subsets(spark):
    f = queries.Frames(spark, SF).with_unlike_classes()
    feat, w = {}, {(r.class_idx, r.formula_id): r.w for r in f.coef().collect()}
    train: dict = {}
    for r in f.feat().collect():
        feat[r.series_id, r.formula_id] = r.rho
        if r.split == "TRAIN":
            train.setdefault((r.formula_id, r.label), []).append(r.rho)
    formulas, classes = range(len(queries.BANK)), range(10)
    box = {j: np.quantile([x for (k, _), v in train.items() if k == j for x in v], [0.1, 0.9]) for j in formulas}
    worst = {(a, b, j): (w[a, j] - w[b, j]) * box[j][0 if w[a, j] > w[b, j] else 1] for a in classes for b in classes if a != b for j in formulas}
    got = queries.ALL["worst_case_whole"][0](f).collect()
    assert len(got) == len(worst) and all(r.worst == pytest.approx(worst[r.class_idx, r.competitor, r.formula_id], abs=2e-6) for r in got)
    subsets = np.array(sorted(itertools.product((0, 1), repeat=len(formulas)), key=sum))
    pred = {r.series_id: r.class_idx for r in f.pred().collect()}
    need = {}
    for s, a in pred.items():
        others = [b for b in classes if b != a]
        gain = np.array([[round((w[a, j] - w[b, j]) * feat[s, j] - worst[a, b, j], 9) for b in others] for j in formulas])
        bar = np.array([round(1e-6 - sum(worst[a, b, j] for j in formulas), 9) for b in others])
        ok = (subsets @ gain >= bar - 1e-12).all(axis=1)
        need[s] = int(subsets[ok.argmax()].sum()) if ok.any() else -1
    assert {r.series_id: r.n_needed for r in run(spark, "abduce_whole")} == need and max(need.values()) > 2
    secured = run(spark, "verified_margins_whole")
    assert len(secured) == 9 * sum(n >= 0 for n in need.values()) > 0 and all(r.secured for r in secured)
    kde = [r for r in run(spark, "kde_whole") if r.density is not None]
    wide = {k for k, v in train.items() if len(v) > 1 and np.std(v, ddof=1) > 1e-12}
    assert {(r.formula_id, r.label) for r in kde} == wide and len(kde) == 400 * len(wide)
    for r in kde[::997]:
        x = np.array(train[r.formula_id, r.label])
        h = np.std(x, ddof=1) * len(x) ** -0.2
        g = x.min() - 1 + (x.max() - x.min() + 2) * r.k / 399
        assert r.density == pytest.approx(np.exp(-(((g - x) / h) ** 2) / 2).mean() / (h * np.sqrt(2 * np.pi)), abs=2e-6)
