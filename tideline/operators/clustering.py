"""Online single-pass clustering of vectors in time order, one group a project and mode."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# fixed values: thresholds of curated items, of search results, and of semantic duplicates
CURATED, SEARCHED, SAME = 0.88, 0.84, 0.985
#: Rows of either side that a task of _twins() holds, and items that it compares at once.
BLOCK, ROWS = 1 << 14, 256


def threshold(mode: Column, searched: Column, base: float) -> Column:
    """The likeness at which an item joins a story: higher for curated items, and for an item that a search found."""
    own = F.when(mode == "curated", F.greatest(F.lit(base), F.lit(CURATED))).otherwise(F.lit(base))
    return F.when(searched, F.greatest(own, F.lit(SEARCHED))).otherwise(own)


class Clusters:
    """Stories seen within a window: sums of unit vectors, their directions, last times and numbers.

    Stories that have left the window of the last item go, so a group needs the
    memory of one window, whatever its length. Items that come late are compared
    with the stories that are left.
    """

    def __init__(self, window: float, kept: float | None = None):
        self.window, self.kept = window, window if kept is None else kept
        self.numbers: list[int] = []
        self.made, self.newest = 0, float("-inf")
        self.sums = self.units = self.last = None

    def _room(self, size: int) -> None:
        n = len(self.numbers)
        if self.sums is None:
            self.sums, self.units, self.last = np.zeros((64, size)), np.zeros((64, size)), np.zeros(64)
        if n == len(self.last):
            live = np.flatnonzero(self.last[:n] >= self.newest - self.kept)
            if len(live) > n // 2:
                self.sums, self.units = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sums, self.units))
                self.last = np.concatenate([self.last, np.zeros_like(self.last)])
            if len(live) < n:
                for x in (self.sums, self.units, self.last):
                    x[: len(live)] = x[live]
                self.numbers = [self.numbers[i] for i in live]

    def _add(self, number: int, total, at: float) -> None:
        self._room(len(total))
        k = len(self.numbers)
        self.numbers.append(number)
        self.sums[k], self.last[k] = total, at
        size = np.linalg.norm(total)
        self.units[k] = total / size if size else total

    def stored(self, number: int, centroid, n: int, at: float) -> None:
        """A story from before: its sum is its centroid times its number of items."""
        self._add(number, np.asarray(centroid, np.float64) * n, at)
        self.made = max(self.made, number + 1)

    def add(self, v, t: float, threshold: float) -> int:
        """The number of the story that takes a vector: the most alike one within the window, else a new one."""
        v = np.asarray(v, np.float64)
        size = np.linalg.norm(v)
        v = v / size if size else v
        self.newest = max(self.newest, t)
        n = len(self.numbers)
        near = np.where(self.last[:n] >= t - self.window, self.units[:n] @ v, -2.0) if n else []
        k = int(near.argmax()) if n else -1
        if n and near[k] >= threshold:
            self.sums[k] += v
            size = np.linalg.norm(self.sums[k])
            self.units[k] = self.sums[k] / size if size else self.sums[k]
            self.last[k] = max(self.last[k], t)
            return self.numbers[k]
        self._add(self.made, v, t)
        self.made += 1
        return self.made - 1


class Accepted:
    """Items that are no duplicates, with their directions, times and stories: what semantic duplicates are held against."""

    def __init__(self, window: float):
        self.window, self.newest, self.n = window, float("-inf"), 0
        self.units = self.times = None
        self.items: list[tuple] = []

    def add(self, t: float, key, number: int, unit) -> None:
        if self.times is None:
            self.units, self.times = np.zeros((64, len(unit))), np.zeros(64)
        if self.n == len(self.times):
            live = np.flatnonzero(self.times >= self.newest - self.window)
            if len(live) > self.n // 2:
                self.units, self.times = (np.concatenate([x, np.zeros_like(x)]) for x in (self.units, self.times))
            if len(live) < self.n:
                self.units[: len(live)], self.times[: len(live)] = self.units[live], self.times[live]
                self.items, self.n = [self.items[i] for i in live], len(live)
        self.units[self.n], self.times[self.n] = unit, t
        self.items.append((key, number))
        self.n += 1
        self.newest = max(self.newest, t)

    def twin(self, t: float, unit, least: float) -> tuple | None:
        """Likeness, key and story of the most alike item of the window, of equals the first, if it is alike enough."""
        self.newest = max(self.newest, t)
        if not self.n:
            return None
        near = np.where(self.times[: self.n] >= t - self.window, self.units[: self.n] @ unit, -2.0)
        best = int(near.argmax())
        return (float(near[best]), *self.items[best]) if near[best] >= least else None


def assign(vectors, times, window: float, threshold: float):
    """Cluster numbers of vectors in order."""
    found = Clusters(window)
    return [found.add(v, t, threshold) for v, t in zip(vectors, times, strict=True)]


def _units(vectors) -> np.ndarray:
    v = np.stack([np.asarray(x, np.float64) for x in vectors])
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(size > 0, size, 1.0)


def nearest(times, vectors, known_times, known, window: float, same: float) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the likeness to the most alike known one that is not a window older, and its place; -2 where none is as alike as `same`.

    Rows of both sides come in order of time; of equally alike ones (to 12 places) the first counts.
    """
    u, w = _units(vectors), _units(known)
    small, since = w.astype(np.float32), np.searchsorted(known_times, np.asarray(times) - window)
    best, at = np.full(len(u), -2.0), np.zeros(len(u), np.int64)
    for lo in range(0, len(u), ROWS):
        base = int(since[lo])
        if base == len(w):
            break
        # single precision leaves out most rows; the others are taken again
        some = lo + np.flatnonzero((u[lo : lo + ROWS].astype(np.float32) @ small[base:].T).max(axis=1) >= same - 1e-4)
        if len(some):
            near = np.round(u[some] @ w[base:].T, 12)
            near[np.arange(base, len(w)) < since[some, None]] = -2.0
            k = near.argmax(axis=1)
            found = near[np.arange(len(some)), k]
            best[some], at[some] = np.where(found >= same, found, -2.0), k + base
    return best, at


def _twins(rows: DataFrame, known: DataFrame, window: float, same: float) -> DataFrame:
    """g, k, near, to (key) and story of rows (g, t, k, v) with a twin among known items (and story x), whatever their order.

    Items from before do not depend on the pass, so they are compared in tasks of BLOCK rows
    of either side, as many as all pairs need; each gives one row an item at most.
    """
    sizes = known.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).join(rows.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cuts")), "g")
    place = F.xxhash64("k")
    many = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = rows.select("g", "t", "k", "v").join(F.broadcast(sizes), "g").select("g", "t", "k", "v", F.pmod(place, "cuts").cast("int").alias("cut"), many("parts").alias("part"))
    y = known.select("g", "t", "k", "v", "x").join(F.broadcast(sizes), "g").select("g", "t", "k", "v", "x", F.pmod(place, "parts").cast("int").alias("part"), many("cuts").alias("cut"))
    kinds = dict(rows.dtypes)

    def compared(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if len(own) and len(other):
            own, other = own.sort_values(["t", "k"]), other.sort_values(["t", "k"])
            near, at = nearest(own["t"].to_numpy(), own["v"], other["t"].to_numpy(), other["v"], window, same)
            to = other.iloc[at]
            found = pd.DataFrame({"g": own["g"].to_numpy(), "k": own["k"].to_numpy(), "near": near, "t": to["t"].to_numpy(), "to": to["k"].to_numpy(), "story": to["x"].to_numpy().astype("int64")})
            return found[near >= same]
        return pd.DataFrame({"g": own["g"][:0], "k": own["k"][:0], "near": [], "t": [], "to": own["k"][:0], "story": []})

    keys = ["g", "part", "cut"]
    pairs = x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInPandas(compared, f"g {kinds['g']}, k {kinds['k']}, near double, t double, to {kinds['k']}, story long")
    first = F.min_by(F.struct("near", "to", "story"), F.struct(-F.col("near"), "t", "to"))
    return pairs.groupBy("g", "k").agg(first.alias("twin")).select("g", "k", "twin.*")


def single_pass(items: DataFrame, group: str, key: str, vector: str, at: str, window: float, threshold: float | str, stored: DataFrame | None = None, same: float | None = None, accepted: DataFrame | None = None) -> DataFrame:
    """group, key, cluster and (with `same`) dup_of of items in order of `at` and key.

    threshold: a number, or a column with each item's own. stored: stories from
    before (group, cluster, centroid, n, last), which take items as well. same:
    items so alike to an accepted one in the window are duplicates of the most
    alike; they join its story and take no part in it. accepted: items from before that
    count as such (the columns of items, and cluster).
    A group's rows come sorted and pass through one task in batches (the
    operator is defined by order); the memory held is that of one window. Accepted
    items may be later than the items; they are compared before, in tasks of their own.
    """
    rule = F.lit(float(threshold)) if not isinstance(threshold, str) else F.col(threshold)

    def rows_of(df: DataFrame, kind: int, own):
        return df.select(F.col(group).alias("g"), F.col(at).cast("double").alias("t"), F.lit(kind).alias("kind"), F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), own.cast("double").alias("x"))

    rows = rows_of(items, 1, rule)
    kinds = dict(rows.dtypes)
    none = [F.lit(-2.0).alias("near"), F.col("k").alias("to"), F.lit(0).cast("long").alias("story")]
    if accepted is not None and same is not None:
        twins = _twins(rows, rows_of(accepted, 0, F.col("cluster")), window, same)
        rows = rows.join(twins, ["g", "k"], "left").select("g", "t", "kind", "k", "v", "x", F.coalesce("near", F.lit(-2.0)).alias("near"), F.coalesce("to", "k").alias("to"), F.coalesce("story", F.lit(0)).alias("story"))
    else:
        rows = rows.select("*", *none)
    if stored is not None:
        old = stored.select(F.col(group).alias("g"), F.col("last").cast("double").alias("t"), F.lit(0).alias("kind"), F.col("cluster").cast(kinds["k"]).alias("k"), F.col("centroid").cast("array<double>").alias("v"), F.col("n").cast("double").alias("x"))
        rows = rows.unionByName(old.select("*", *none))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, clusters, known = object(), None, None
        for batch in batches:
            out = []
            for g, t, kind, k, v, x, near, to, story in batch[["g", "t", "kind", "k", "v", "x", "near", "to", "story"]].itertuples(index=False):
                if g != now:
                    now, clusters, known = g, Clusters(window), Accepted(window)
                if not kind:
                    clusters.stored(int(k), v, int(x), t)
                    continue
                u = np.asarray(v, np.float64)
                u = u / (np.linalg.norm(u) or 1.0)
                twin = known.twin(t, u, same) if same is not None else None
                if near > -2 and (twin is None or near >= round(twin[0], 12)):
                    twin = near, to, int(story)
                number = twin[2] if twin else clusters.add(v, t, x)
                if same is not None and not twin:
                    known.add(t, k, number, u)
                out.append((g, k, number, twin[1] if twin else None))
            if out:
                yield pd.DataFrame(out, columns=["g", "k", "cluster", "dup_of"])

    ordered = rows.repartition("g").sortWithinPartitions("g", "kind", "t", "k")
    found = ordered.mapInPandas(run, f"g {kinds['g']}, k {kinds['k']}, cluster long, dup_of {kinds['k']}")
    extra = ["dup_of"] if same is not None else []
    return found.select(F.col("g").alias(group), F.col("k").alias(key), "cluster", *extra)


def streamed(items: DataFrame, group: str, key: str, vector: str, at: str, window: float, threshold: float, late: float = 0.0) -> DataFrame:
    """single_pass() over a stream: group, key, cluster of the items of each batch in order of `at` and key.

    Each story of a group is an entry of the group's state, read and written by
    itself. An item is compared with the stories of its own window, whenever it
    comes: stories are kept until they are `window` and `late` older than the newest
    item of their group, so an item that is `late` at most meets all stories of its
    window. Later ones meet what is left; none is dropped. Items without a vector wait
    for one: they are left out.

    The session must keep stream state in RocksDB (see keyed_state()).
    """
    kinds = dict(items.dtypes)
    rows = items.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), F.col(at).cast("double").alias("t")).where("v is not null")
    found = rows.groupBy("g").transformWithStateInPandas(StoriesOfAGroup(window, threshold, late), f"g {kinds[group]}, k {kinds[key]}, cluster int", "append", "None")
    return found.select(F.col("g").alias(group), F.col("k").alias(key), "cluster")


def keyed_state(spark: SparkSession) -> None:
    """Keep the state of this session's streams in RocksDB, which state with entries of its own needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class StoriesOfAGroup(StatefulProcessor):
    """The stories of one group: an entry for each, and how many there were and the newest time."""

    def __init__(self, window: float, threshold: float, late: float):
        self.window, self.threshold, self.late = window, threshold, late

    def init(self, handle) -> None:
        self.stories = handle.getMapState("stories", "number int", "total array<double>, last double")
        self.seen = handle.getValueState("seen", "made int, newest double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        made, newest = self.seen.get() if self.seen.exists() else (0, float("-inf"))
        clusters = Clusters(self.window, self.window + self.late)
        clusters.newest = newest
        before = {}
        for (number,), (total, last) in sorted(self.stories.iterator(), key=lambda x: x[0][0]):
            before[number] = last
            clusters._add(number, np.array(total, np.float64), last)
        clusters.made = made
        batch = pd.concat(list(rows)).sort_values(["t", "k"])
        numbers = [clusters.add(v, t, self.threshold) for v, t in zip(batch["v"], batch["t"], strict=True)]
        changed = set(numbers)
        kept = {n: i for i, n in enumerate(clusters.numbers) if clusters.last[i] >= clusters.newest - clusters.kept}
        for number in before.keys() - kept.keys():
            self.stories.removeKey((number,))
        for number in changed & kept.keys():
            i = kept[number]
            self.stories.updateValue((number,), (clusters.sums[i].tolist(), float(clusters.last[i])))
        self.seen.update((clusters.made, float(clusters.newest)))
        yield pd.DataFrame({"g": batch["g"], "k": batch["k"], "cluster": np.array(numbers, np.int32)})

    def close(self) -> None:
        pass
