import collections
import hashlib
import random

import pytest

from versionlake.operators import splits


def plain(sizes, n_test, n_held, val_ratio, test_ratio):
    """Rows of each work in test, work after work in the order of their hashes."""
    order = sorted(sizes, key=lambda w: hashlib.md5(f"7|{w}".encode()).hexdigest())
    test, train, out = sum(sizes[w] for w in order[:n_test]), 0, {}
    for w in order[n_held:]:
        n = sizes[w]
        val, share = max(1, int(n * val_ratio)), max(1, int(n * test_ratio))
        if train and test / train > test_ratio:
            share = max(1, share - 1)
        out[w] = min(share, max(0, n - val))
        test, train = test + out[w], train + max(0, n - val - share)
    return out


@pytest.mark.parametrize("seed,sizes,unseen,ratios", [
    (1, (1, 60), 0.0, (0.1, 0.1)), (2, (1, 60), 0.1, (0.1, 0.1)), (3, (20, 21), 0.02, (0.25, 0.3)),
    (4, (1, 3), 0.1, (0.1, 0.2)), (5, (1, 200), 0.05, (0.6, 0.35))])
def test_running_ratio(spark, seed, sizes, unseen, ratios):
    rng = random.Random(seed)
    works = {f"w{i}": rng.randint(*sizes) for i in range(60)}
    rows = [(w, f"{w}-{i}", "x") for w, n in works.items() for i in range(n)]
    df = spark.createDataFrame(rows, "work_id string, id string, other string")
    n_test = max(1, int(60 * unseen)) if unseen else 0
    want = plain(works, n_test, 2 * n_test, *ratios)
    for range_works in (100_000, 4):
        got = collections.Counter()
        held = set()
        for r in splits.split_by_work(df, "id", val_unseen=unseen, test_unseen=unseen, val_ratio=ratios[0],
                                      test_ratio=ratios[1], seed=7, keep_ratio=True, range_works=range_works).collect():
            got[r["work_id"], r["split"]] += 1
        for w, n in works.items():
            if w not in want:
                held.add(w)
                assert got[w, "test"] in (0, n) and got[w, "train"] == 0
            else:
                assert got[w, "test"] == want[w], (w, range_works)
                assert got[w, "train"] + got[w, "val"] + got[w, "test"] == n
        assert len(held) == 2 * n_test
    plain_test = {w: min(max(1, int(n * ratios[1])), max(0, n - max(1, int(n * ratios[0])))) for w, n in works.items()}
    if seed in (2, 3):
        assert any(want[w] < plain_test[w] for w in want)


def test_running_ratio_without_works(spark):
    df = spark.createDataFrame([], "work_id string, id string")
    assert splits.split_by_work(df, "id", keep_ratio=True).count() == 0


def test_thresholds_of_a_walk():
    rng = random.Random(9)
    for _ in range(200):
        bounds = [rng.randint(-3, 12) for _ in range(rng.randint(0, 12))]
        found = splits._thresholds(bounds)
        for x in range(-8, 20):
            done = x
            for c in bounds:
                done += done <= c
            assert done == x + sum(t >= x for t in found), (bounds, x)


@pytest.mark.parametrize("walk_works", [1, 9, 100_000])
def test_running_ratio_in_few_jobs(spark, walk_works):
    rng = random.Random(3)
    sizes = [(w, rng.randint(20, 400)) for w in range(1, 241)]
    works = spark.createDataFrame([(w, n, n // 5, n // 10) for w, n in sizes], "_w bigint, _n bigint, _v bigint, _t bigint")
    test, train, want = sum(n for _, n in sizes[:8]), 0, []
    for w, n in sizes[16:]:
        less = bool(train and test / train > 0.1)
        take = n // 10 - less
        test, train = test + take, train + n - n // 5 - take
        want += [w] * less
    assert 10 < len(want) < 224
    got = splits._reduced_works(works, 8, 16, 0.1, 3, walk_works)
    assert sorted(r["_w"] for r in got.collect()) == want


def test_walks_are_not_repeated_a_range(spark):
    """One pass over walks of many ranges: the number of jobs doesn't grow with the ranges."""
    works = spark.createDataFrame([(w, 40, 8, 4) for w in range(1, 301)], "_w bigint, _n bigint, _v bigint, _t bigint")
    spark.sparkContext.setJobGroup("walk", "jobs of the walk")
    found = splits._reduced_works(works, 30, 60, 0.1, 2).count()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("walk"))
    spark.sparkContext._jsc.clearJobGroup()
    assert found > 0 and jobs < 30
