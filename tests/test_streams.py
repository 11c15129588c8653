"""Streams with keyed state: late rows, restarts, flat state; batches that are written again."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import clustering
from tideline.streaming import windows

ITEM = "g string, k long, v array<double>, t double"


def turned(rng, centre):
    """A vector near one of four directions."""
    v = np.zeros(4)
    v[centre] = 1.0
    return (v + rng.normal(0, 0.05, 4)).tolist()


def feed(spark, folder, batches):
    """Each batch as a file, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ITEM).coalesce(1).write.parquet(f"{folder}/{i:04}")


def streamed(spark, folder, base, **more):
    clustering.keyed_state(spark)
    source = spark.readStream.schema(ITEM).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    found = clustering.streamed(source, "g", "k", "v", "t", 10.0, 0.8, **more)
    return {r.k: r.cluster for r in windows.drained(found, base=base).collect()}


def by_hand(batches, late):
    """A plain loop: each item meets all stories that were seen in its window, of those not older than the newest item allows."""
    stories, newest, found = {}, {}, {}
    for rows in batches:
        for g, k, v, t in sorted(rows, key=lambda r: (r[3], r[1])):
            u = np.array(v) / np.linalg.norm(v)
            newest[g] = max(newest.get(g, -np.inf), t)
            own = stories.setdefault(g, [])
            near = [(float(s["sum"] / np.linalg.norm(s["sum"]) @ u), -i) for i, s in enumerate(own) if s["last"] >= t - 10 and s["last"] >= s.get("floor", -np.inf)]
            best = max(near, default=(-2, 0))
            if best[0] >= 0.8:
                s = own[-best[1]]
                s["sum"], s["last"] = s["sum"] + u, max(s["last"], t)
                found[k] = -best[1]
            else:
                own.append({"sum": u, "last": t})
                found[k] = len(own) - 1
        for g in stories:
            for s in stories[g]:
                if s["last"] < newest[g] - 10 - late:
                    s["floor"] = np.inf
    return found


def test_late_rows_meet_the_stories_of_their_window(spark, tmp_path):
    x, y = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    batches = [[("a", 1, x, 0.0), ("a", 2, y, 5.0)], [("a", 3, x, 25.0)], [("a", 4, x, 6.0), ("a", 5, y, 30.0)], [("a", 6, y, 12.0)]]
    feed(spark, tmp_path / "in", batches)
    # 4 is 19 late and belongs to the story of 1; the story of 3 is later than its window, but was seen after it
    found = streamed(spark, tmp_path / "in", str(tmp_path / "out"), late=20.0)
    assert found == by_hand(batches, 20.0)
    assert found[1] != found[2] and found[4] in (found[1], found[3]) and found[6] == found[2]


def test_restart_goes_on_with_the_same_stories(spark, tmp_path):
    rng = np.random.default_rng(3)
    numbers = iter(range(1000))
    batches = [[(g, next(numbers), turned(rng, int(rng.integers(4))), float(6 * b + rng.integers(12) - 3)) for g in ("a", "b") for _ in range(8)] for b in range(6)]
    feed(spark, tmp_path / "whole", batches)
    whole = streamed(spark, tmp_path / "whole", str(tmp_path / "one"), late=5.0)
    assert whole == by_hand(batches, 5.0)
    feed(spark, tmp_path / "parts", batches[:2])
    part = streamed(spark, tmp_path / "parts", str(tmp_path / "two"), late=5.0)
    assert part == {k: whole[k] for k in part} and len(part) == 32
    for i, rows in enumerate(batches[2:], 2):
        spark.createDataFrame(rows, ITEM).coalesce(1).write.parquet(f"{tmp_path}/parts/{i:04}")
    assert streamed(spark, tmp_path / "parts", str(tmp_path / "two"), late=5.0) == whole


class Kept:
    """Stands for a handle of keyed state."""

    def __init__(self):
        self.map, self.value = {}, None

    def getMapState(self, *_):  # noqa: N802
        return self

    getValueState = getMapState  # noqa: N815

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def iterator(self):
        return iter(list(self.map.items()))

    def updateValue(self, key, value):  # noqa: N802
        self.map[key] = value

    def removeKey(self, key):  # noqa: N802
        del self.map[key]


def test_state_stays_flat():
    import pandas as pd

    rng, state = np.random.default_rng(5), Kept()
    stories = clustering.StoriesOfAGroup(10.0, 2.0, 5.0)
    stories.init(state)
    sizes = []
    for b in range(100):
        rows = pd.DataFrame({"g": "a", "k": range(20 * b, 20 * b + 20), "v": [turned(rng, i % 4) for i in range(20)], "t": [5.0 * b + i / 4 for i in range(20)]})
        found = pd.concat(stories.handleInputRows(("a",), iter([rows[:7], rows[7:]]), None))
        assert found["cluster"].tolist() == list(range(20 * b, 20 * b + 20))
        sizes.append(len(state.map))
    assert max(sizes[10:]) == min(sizes[10:]) <= 80


def test_a_batch_that_runs_again_is_written_once(spark, tmp_path):
    rng = random.Random(1)
    feed(spark, tmp_path / "in", [[("a", i, [1.0], rng.random())] for i in range(3)])
    source = spark.readStream.schema(ITEM).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*").select("g", "k")
    base = str(tmp_path / "out")
    windows.drained(source, base=base)
    spark.createDataFrame([("a", 1)], "g string, k long").write.mode("overwrite").parquet(f"{base}/rows/_batch=1")  # as a retry would
    assert sorted(r.k for r in windows.drained(source, base=base).collect()) == [0, 1, 2]
    empty = spark.readStream.schema(ITEM).parquet(f"{tmp_path}/in/*").where(F.col("k") < 0)
    assert windows.drained(empty).count() == 0
    assert windows.drained(empty.groupBy("g").count(), ["g"]).count() == 0


@pytest.mark.parametrize("late", [0.0, 50.0])
def test_streams_of_one_batch_are_single_pass(spark, tmp_path, late):
    rng = np.random.default_rng(9)
    rows = [("a", i, turned(rng, int(rng.integers(4))), float(i)) for i in range(60)]
    feed(spark, tmp_path / "in", [rows])
    table = clustering.single_pass(spark.createDataFrame(rows, ITEM), "g", "k", "v", "t", 10.0, 0.8)
    assert streamed(spark, tmp_path / "in", str(tmp_path / "out"), late=late) == {r.k: r.cluster for r in table.collect()}
