import numpy as np
import pytest

from siltstone.llm.blend import blend, blend_shares, water_fill

ROWS = "row_id long, source string, split string, uses int, h string"
TARGETS = "source string, weight double, requested_rows long, max_repeats int, n int"


def clamp_one_by_one(weights, caps, total):
    """Brute force: the exact shares, sources clamped until nothing changes."""
    due, free = [0.0] * len(weights), {i for i, (w, c) in enumerate(zip(weights, caps)) if w > 0 and c > 0}
    while free:
        level = (total - sum(due)) / sum(weights[i] for i in free)
        over = {i for i in free if level * weights[i] >= caps[i]}
        if not over:
            return [level * weights[i] if i in free else d for i, d in enumerate(due)]
        for i in over:
            due[i] = float(caps[i])
        free -= over
    return due


def test_water_fill(spark):
    rng = np.random.default_rng(5)
    for total in (0, 1, 37, 900, 5000):
        n = int(rng.integers(1, 40))
        weights, caps = rng.choice([0.0, 0.1, 0.5, 1.0, 7.0, 5e-324], n), rng.integers(0, 300, n)
        df = spark.createDataFrame([(f"s{i:02d}", float(w), int(c)) for i, (w, c) in enumerate(zip(weights, caps))], "source string, weight double, cap long")
        got = {r.source: r.used for r in water_fill(df, total).collect()}
        due = clamp_one_by_one(weights.tolist(), caps.tolist(), total)
        assert sum(got.values()) == round(sum(due))
        assert all(abs(got.get(f"s{i:02d}", 0) - d) < 1 + 1e-6 and got.get(f"s{i:02d}", 0) <= caps[i] for i, d in enumerate(due))


def test_blend_reaches_its_shares(spark):
    rows = [(i, "a" if i < 600 else "b" if i < 650 else "c", "train" if i % 2 else "pretrain", 1, "x") for i in range(700)] + [(900, None, "train", 1, ""), (901, "a", "val", 1, ""), (902, "z", "train", 1, ""), (903, "a", None, 1, "")]
    targets = [("a", 0.5, 300, 1, 0), ("b", 0.3, 200, 3, 0), ("c", 0.2, 100, 1, 0), ("none", 0.1, 0, 2, 0)]
    df, t = spark.createDataFrame(rows, ROWS), spark.createDataFrame(targets, TARGETS)
    got = blend(df, t).toPandas()
    assert len(got) == 600 and not got.duplicated().any()
    uses = got.groupby(["source", "row_id"]).size()
    assert uses["a"].max() == 1 and uses["b"].max() <= 3 and uses["c"].tolist() == [1] * 50
    assert uses["b"].max() - uses["b"].min() <= 1
    again = blend(df.repartition(11), t).toPandas()
    assert set(map(tuple, got.itertuples(index=False))) == set(map(tuple, again.itertuples(index=False)))
    shares = blend_shares(df, t).toPandas().set_index("source")
    assert shares.reached_rows.sum() == 600 and shares.loc["none", "reached_rows"] == 0 and abs(shares.reached_share.sum() - 1) < 1e-9


@pytest.mark.parametrize("rows,targets", [([], [("a", 1.0, 10, 1, 0)]), ([(1, "a", "train", 1, "")], []), ([(1, "a", "train", 1, "")], [("a", None, None, None, 0)])])
def test_small_tables(spark, rows, targets):
    df, t = spark.createDataFrame(rows, ROWS), spark.createDataFrame(targets, TARGETS)
    assert blend(df, t).count() == 0 and blend_shares(df, t).count() == len(targets)
