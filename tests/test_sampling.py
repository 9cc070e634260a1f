"""Safe background samples against a plain numpy reading of the rule, and what they must keep away from."""
import numpy as np
import pytest

from pixtables.operators import sampling as op
from pixtables.session import IMAGE_PIXELS, declare_image_size

TERMS = lambda u, v: np.stack([np.ones_like(u), u, v, u * u, u * v, v * v], -1)


def scene(seed, h=120, w=132, noise=0.002, stars=((20, 20), (90, 30), (30, 100), (96, 110))):
    """A sloping sky with a nebula, a dark cloud and stars."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w].astype(float)
    img = 0.10 + 0.03 * x / w + 0.02 * y / h + rng.normal(0, noise, (h, w))
    img += 0.12 * np.exp(-((y - h * 0.48) ** 2 + (x - w * 0.5) ** 2) / (2 * 11.0**2))
    img -= 0.02 * np.exp(-((y - h * 0.8) ** 2 + (x - w * 0.5) ** 2) / (2 * 5.0**2))
    for sy, sx in stars:
        img += 0.3 * np.exp(-((y - sy) ** 2 + (x - sx) ** 2) / (2 * 1.5**2))
    return img


def dev(v):
    return 1.4826 * np.median(abs(v - np.median(v)))


def smooth(a):
    for _ in range(2):
        p = np.pad(a, 1, mode="reflect")
        a = np.lib.stride_tricks.sliding_window_view(p, (3, 3)).mean((2, 3))
    return a


def grown(a, n):
    return np.lib.stride_tricks.sliding_window_view(np.pad(a, n), (2 * n + 1, 2 * n + 1)).any((2, 3))


def fitted(design, v, use, floor, rounds, low, high, least):
    coef, inside = np.zeros(6), use
    for _ in range(rounds):
        if inside.sum() < least:
            break
        coef = np.linalg.lstsq(design[inside], v[inside], rcond=None)[0]
        res = v - design @ coef
        s = max(dev(res[inside]), floor)
        c = np.median(res[inside])
        inside = use & (res >= c - low * s) & (res <= c + high * s)
    return coef


def unit(img):
    a, b = np.quantile(img[np.isfinite(img)], (0.005, 0.995))
    return np.clip(np.nan_to_num((img - a) / (b - a), posinf=0, neginf=0), 0, 1)


def masks(l):  # noqa: E741
    h, w = l.shape
    lo, hi = np.quantile(l, (0.005, 0.995))
    dynamic = max(hi - lo, 1e-8)
    low = l - l.min() <= max(dynamic * 1e-7, 64 * np.finfo(float).eps)
    covered = low & (low.mean() >= 0.002)
    yy, xx = np.mgrid[:h, :w]
    t = TERMS(xx / (w - 1), yy / (h - 1)).reshape(-1, 6)
    free = ~covered
    res = l - (t @ fitted(t, l.ravel(), free.ravel(), dynamic * 1e-4, 5, 3.5, 1.6, 64)).reshape(h, w)
    c, s = np.median(res[free]), max(dev(res[free]), dynamic * 1e-4)
    up, down = smooth((res > c + 1.5 * s).astype(float)), smooth((res < c - 1.5 * s).astype(float))
    fine = l - smooth(l)
    out = {"covered": covered, "compact": grown((fine > 4 * max(dev(fine[free]), dynamic * 1e-4)) & free, 1), "extended": grown((up >= 0.7) & (res > c + 0.5 * s) & free, 2)}
    out["core"] = ((res > c + 5 * s) | (l >= hi)) & free & out["extended"]
    out["dark"] = grown((down >= 0.7) & (res < c - 0.5 * s) & free, 1)
    out["halo"] = grown((up >= 0.55) & (res > c + 0.35 * s) & free, 3)
    out["source"] = (out["compact"] | out["extended"] | out["core"]) & free
    return out


def samples(img, valid=None, saturated=None, star=None, target=40, steps=8, keep_grid=False, radius=5, least_radius=4, least=16):
    """(status, {(y, x): source}) by the rule, one candidate after the other."""
    h, w = img.shape
    none = np.zeros((h, w), bool)
    valid, saturated = ~none if valid is None else valid, none if saturated is None else saturated
    r = max(least_radius, min(radius, 24, max(least_radius, min(h, w) // 12)))
    margin = max(r + 2, round(min(h, w) * 0.04))
    if np.ptp(np.quantile(img[np.isfinite(img)], (0.005, 0.995))) <= 1e-12 or min(h, w) <= 2 * margin + 4:
        return "unavailable", {}
    l = unit(img)  # noqa: E741
    m = masks(l)
    bad = m["covered"] | m["compact"] | m["extended"] | m["core"] | m["dark"]
    usable = 1 - (bad | (none if star is None else star)).mean()
    low, bright, top = np.quantile(l, (0.015, 0.9, 0.98))
    dynamic = max(top - low, 1e-8)
    budget = target * (6 if star is not None and star.mean() >= 0.15 else 4)
    cols = max(8, round(np.sqrt(budget * w / h)))
    rows = max(6, int(np.ceil(budget / cols)))
    places = [(round(float(y)), round(float(x))) for y in np.linspace(margin, h - margin - 1, rows) for x in np.linspace(margin, w - margin - 1, cols)]

    def measure(y, x):
        s = np.s_[y - r : y + r + 1, x - r : x + r + 1]
        p = l[s]
        return {"y": y, "x": x, "s": s, "median": np.median(p), "texture": (np.median(abs(np.diff(p, axis=1))) + np.median(abs(np.diff(p, axis=0)))) / 2, "excess": max(0, np.quantile(p, 0.95) - np.median(p))}

    grid = [measure(*at) for at in places]
    t = lambda c: TERMS(np.array([c["x"] / (w - 1)]), np.array([c["y"] / (h - 1)]))[0]
    coef = fitted(np.array([t(c) for c in grid]), np.array([c["median"] for c in grid]), np.ones(len(grid), bool), dynamic * 0.003, 3, 2.5, 1.5, 12)
    rest = lambda c: c["median"] - t(c) @ coef
    r_lo, r_hi = np.quantile([rest(c) for c in grid], (0.10, 0.70))
    t_max = max(np.quantile([c["texture"] for c in grid], 0.55), dynamic * 1e-5)
    s_max = max(np.quantile([c["excess"] for c in grid], 0.60), dynamic * 0.003)

    def risk(c):
        s, e = c["s"], rest(c)
        if not valid[s].all() or saturated[s].any() or bad[s].any() or (star is not None and star[s].any()):
            return None
        if not (low < c["median"] <= bright and r_lo <= e <= r_hi and c["texture"] <= t_max and c["excess"] <= s_max):
            return None
        return 0.45 * (e - r_lo) / max(r_hi - r_lo, 1e-8) + 0.35 * c["texture"] / t_max + 0.2 * c["excess"] / s_max

    found = [(k, c["y"], c["x"], risk(c), False) for k, c in enumerate(grid)]
    seen = set(places)
    if usable >= 0.5 and m["source"].mean() <= 0.5:
        for k, y, x, own, _ in list(found):
            step, used = max(r, round(min(h, w) * 0.018)), 0
            while step >= max(2, r // 2) and used < steps:
                near = [(y + a * step, x + b * step) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
                near = [(risk(measure(*p)), *p) for p in near if margin <= p[0] < h - margin and margin <= p[1] < w - margin]
                best = min((n for n in near if n[0] is not None), default=None)
                if best and (own is None or best[0] + 1e-12 < own):
                    (own, y, x), used = best, used + 1
                else:
                    step //= 2
            if used and (y, x) not in seen:
                seen.add((y, x))
                found.append((k + len(grid), y, x, own, True))
    safe = [f for f in found if f[3] is not None]
    cells = {}
    for f in safe:
        cells.setdefault((min(3, f[1] * 4 // h), min(3, f[2] * 4 // w)), []).append(f)
    chosen = []

    def take(fs):
        for f in fs:
            if len(chosen) < target and all(np.hypot(f[1] - g[1], f[2] - g[2]) >= max(2 * r, round(min(h, w) * 0.035)) for g in chosen):
                chosen.append(f)
                return

    for only in ([True] if keep_grid else []) + [False]:
        part = {k: sorted((f for f in v if not only or not f[4]), key=lambda f: (f[3], f[1], f[2])) for k, v in cells.items()}
        for k in sorted((k for k in part if part[k]), key=lambda k: (len(part[k]), part[k][0][3], k)):
            take(part[k])
    for f in sorted(safe, key=lambda f: (f[3], f[4], f[0])):
        take([f])
    span = lambda i, n: (max(f[i] for f in chosen) - min(f[i] for f in chosen)) / (n - 1) if chosen else 0
    ready = len(chosen) >= least and usable >= 0.5 and len({(f[1] >= h / 2, f[2] >= w / 2) for f in chosen}) >= 3 and len({(min(3, f[1] * 4 // h), min(3, f[2] * 4 // w)) for f in chosen}) >= 8 and min(span(1, h), span(2, w)) >= 0.55
    return "ready" if ready else "insufficient_safe_coverage", {(f[1], f[2]): "dark_patch_refinement" if f[4] else "regular_grid" for f in chosen}


def rows(key, img, valid=None, saturated=None, star=None):
    h, w = img.shape
    flag = lambda a, y, x: None if a is None else bool(a[y, x])
    return [(key, y, x, h, w, None if np.isnan(img[y, x]) else float(img[y, x]), flag(valid, y, x), flag(saturated, y, x), flag(star, y, x)) for y in range(h) for x in range(w)]


SCHEMA = "image_id long, y int, x int, h int, w int, l double, valid boolean, saturated boolean, star boolean"


@pytest.fixture(scope="module")
def cases():
    plain, holed, framed = scene(1), scene(2), scene(3, 100, 150)
    holed[40:44, 60:70] = np.nan
    framed[:, :9] = 0.0  # a blank border, repeated floor
    half = np.ones((120, 132), bool)
    half[:, 66:] = False
    spots = np.zeros((120, 132), bool)
    spots[10::40, 10::40] = True
    spots = grown(spots, 4)
    full = np.zeros((120, 132), bool)
    full[::16, ::16] = True
    return {
        1: (plain, {}), 2: (holed, {}), 3: (framed, {}), 4: (scene(4), {"valid": half}), 5: (scene(5), {"star": spots}), 6: (np.full((64, 64), 0.05), {}), 7: (scene(6, 18, 40), {}), 8: (scene(7), {"saturated": full}),
        9: (scene(8, stars=[(y, x) for y in range(6, 120, 9) for x in range(6, 132, 9)]), {})}


@pytest.fixture(scope="module")
def result(spark, cases):
    data = [r for k, (img, flags) in cases.items() for r in rows(k, img, **flags)]
    pix = spark.createDataFrame(data, SCHEMA).repartition(8, "image_id").cache()
    declare_image_size(spark, 150 * 132)
    chosen, report = op.safe_background_samples(pix, radius=5)
    yield pix, chosen.collect(), {r.image_id: r for r in report.collect()}
    spark.conf.unset(IMAGE_PIXELS)


def test_masks(result, cases):
    pix, _, _ = result
    p, _ = op.normalised(pix.where("image_id < 4"))
    got = op.sky_masks(p).collect()
    for k in (1, 2, 3):
        want = masks(unit(cases[k][0]))
        assert {n: int(v.sum()) for n, v in want.items()} == {n: sum(r[n] for r in got if r.image_id == k) for n in want}
        assert all(bool(want[n][r.my, r.mx]) == r[n] for r in got if r.image_id == k for n in want)


def test_samples_and_status(result, cases):
    _, chosen, report = result
    states = set()
    for k, (img, flags) in cases.items():
        status, want = samples(img, **flags)
        assert report[k].status == status, k
        assert {(r.y, r.x): r.source for r in chosen if r.image_id == k} == want, k
        assert report[k].selected == len(want)
        states.add(status)
    assert states == {"ready", "insufficient_safe_coverage", "unavailable"}
    assert any(r.source == "dark_patch_refinement" for r in chosen) and any(r.source == "regular_grid" for r in chosen)


def test_reasons(result):
    _, chosen, report = result
    assert report[4].shared_invalid_region > 0 and report[8].shared_saturated > 0
    assert report[5].shared_catalog_star > 0 and report[1].exclusion_masked > 0
    for r in chosen:
        if r.image_id == 1:  # nebula and stars
            assert np.hypot(r.y - 57.6, r.x - 66) > 20
            assert min(np.hypot(r.y - y, r.x - x) for y, x in ((20, 20), (90, 30), (30, 100), (96, 110))) > 9


def test_options(spark, cases):
    pix = spark.createDataFrame(rows(1, cases[1][0]), SCHEMA).repartition(4, "y")
    kept, _ = op.safe_background_samples(pix, keep_grid=True, target=24, radius=5)
    assert {(r.y, r.x): r.source for r in kept.collect()} == samples(cases[1][0], target=24, keep_grid=True)[1]
    still, report = op.safe_background_samples(pix.drop("valid", "saturated", "star"), refine=False, radius=5)
    assert {r.source for r in still.collect()} == {"regular_grid"} and not report.first().refined
    none, report = op.safe_background_samples(pix.where("false"))
    assert none.count() == 0 and report.count() == 0


def test_query_on_the_given_tables(spark, sf):
    from pixtables.plans import QUERIES
    from pixtables.sources import fixtures as fx

    got = QUERIES["safe_background_samples"](spark, sf).collect()
    report = {r.image_id: r for r in got}
    images = {}
    for r in fx.dlum(spark, sf).select("image_id", "y", "x", "l").collect():
        images.setdefault(r.image_id, np.zeros((16, 16)))[r.y, r.x] = r.l
    assert set(report) == set(images)
    for k, img in images.items():
        status, want = samples(img, target=16, radius=2, least_radius=2, least=12)
        assert report[k].status == status, k
        assert {(r.y, r.x): r.source for r in got if r.image_id == k and r.id is not None} == want, k
