"""Operator 12: hard negatives by a multiway hyperplane tree (GNAT).

A bounded sample gives the tree: a node has up to ``FAN`` split points that lie far apart, a row goes to the nearest one,
and each split point keeps the range of its distances to the rows below every sibling, taken over all rows. Vectors become
integers and are lifted onto one sphere by a further component, so that a window of inner products with an anchor is exactly
an annulus of distances around it. A subtree is left out where some split point's range to it does not meet that annulus.
What is left are whole leaves, searched exactly.

Both searches (an anchor's positives, then the negatives of each positive's window) run alike: first the leaves nearest to
the anchor, whose fifth best row narrows the window, then all other leaves that the narrowed annulus meets. Leaves are cut
into blocks by hash, anchors into groups, and a block returns its best few per window only, so no leaf, anchor or label is
ever whole in a task; a row stands in one leaf, whatever its label.

Defined results: rows whose label, vector or ``vec_id`` is null, or whose vector holds a null or non-finite component, take
no part, nor do rows whose integer vector is so long that inner products might not fit a long (squared length above
``2 ** 62``); vectors of different lengths are never compared; rows that repeat count each, but an anchor repeated whole is
asked once, and rows with the anchor's ``vec_id`` are neither its positives nor its negatives; equal rows tie by ``vec_id``;
an empty vector has product 0 with others of its kind; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import stored

#: Rows the tree is fitted on at most; every row is placed in it.
SAMPLE = 1 << 15
#: Split points of a node, rows of a leaf aimed at, leaves at most.
FAN, LEAF, LEAVES = 8, 512, 2048
#: Leaves an anchor asks first; rows of a leaf, and anchors, worked at a time.
FIRST, BLOCK, ANCHORS = 3, 4096, 1024
#: Largest squared length of an integer vector.
LONGEST = 2 ** 62


class Tree:
    """Split points and children of inner nodes; a child of -1 - k is leaf k. ``low`` and ``high`` are set later."""

    def __init__(self, sample: np.ndarray, radius: float, leaves: int, fan: int = FAN):
        self.radius, self.points, self.children, self.leaf_points = radius, [], [], []
        if len(sample) == 0 or leaves <= 1:
            self.leaves = 1
        else:
            self._grow(sample, leaves, fan)
            self.leaves = len(self.leaf_points)

    def _grow(self, rows: np.ndarray, leaves: int, fan: int) -> int:
        node = len(self.points)
        self.points.append(None)
        self.children.append(None)
        points = apart(rows, min(fan, leaves))
        own = squared(rows, points).argmin(axis=1)
        children = []
        for k in range(len(points)):
            part = rows[own == k]
            share = round(leaves * len(part) / len(rows))
            if share > 1 and len(part) >= 2 * fan:
                children.append(self._grow(part, share, fan))
            else:
                children.append(-1 - len(self.leaf_points))
                self.leaf_points.append(points[k])
        self.points[node], self.children[node] = points, np.array(children)
        return node

    def place(self, rows: np.ndarray, seen) -> np.ndarray:
        """Leaf of each lifted row; ``seen(node, child, distances)`` meets all rows going down to a child."""
        leaf = np.zeros(len(rows), dtype=np.int64)
        todo = [(0, np.arange(len(rows)))] if self.points else []
        while todo:
            node, at = todo.pop()
            far = np.sqrt(squared(rows[at], self.points[node]))
            own = far.argmin(axis=1)
            for k, child in enumerate(self.children[node]):
                mine = own == k
                if mine.any():
                    seen(node, k, far[mine])
                    if child >= 0:
                        todo.append((int(child), at[mine]))
                    else:
                        leaf[at[mine]] = -1 - child
        return leaf

    def reach(self, ask: np.ndarray, length: int, low: np.ndarray, high: np.ndarray) -> list[int]:
        """Leaves that may hold a product with ``ask`` (squared length ``length``) in any window ``low`` to ``high``."""
        if not self.points:
            return [0]
        whole = float(length) + self.radius ** 2
        slack = 1e-6 * (1 + self.radius + float(length) ** 0.5)
        inner, outer = (np.sqrt(np.maximum(whole - 2 * x, 0)) for x in (high, low))
        inner, outer = inner - slack, outer + slack
        found, todo = [], [(0, np.arange(len(low)))]
        while todo:
            node, windows = todo.pop()
            far = np.sqrt(np.maximum(whole - 2 * (self.points[node][:, :-1] @ ask), 0))[:, None, None]
            near_end = np.maximum(far - outer[windows], inner[windows] - far)
            meets = (self.low[node][:, :, None] <= far + outer[windows]) & (self.high[node][:, :, None] >= near_end)
            alive = meets.all(axis=0)  # every split point must allow the child
            for k, child in enumerate(self.children[node]):
                if alive[k].any():
                    if child >= 0:
                        todo.append((int(child), windows[alive[k]]))
                    else:
                        found.append(int(-1 - child))
        return found

    def nearest(self, asks: np.ndarray) -> np.ndarray:
        """The leaves whose split points have the largest products with each row of ``asks``."""
        if not self.points:
            return np.zeros((len(asks), 1), dtype=np.int64)
        return np.argsort(-(asks @ np.stack(self.leaf_points)[:, :-1].T), axis=1, kind="stable")[:, :FIRST]


def squared(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.maximum(np.square(rows).sum(axis=1)[:, None] + np.square(points).sum(axis=1) - 2 * rows @ points.T, 0)


def apart(rows: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` points far from each other, picked greedily among evenly spread rows."""
    among = rows[np.linspace(0, len(rows) - 1, min(len(rows), 3 * k)).astype(int)]
    picked, far = [0], squared(among, among[:1])[:, 0]
    while len(picked) < k and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, squared(among, among[picked[-1:]])[:, 0])
    return among[picked]


def _lifted(x: np.ndarray, length: np.ndarray, radius: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(radius ** 2 - length, 0))])


def _whole(column: pa.Array, rows: int) -> np.ndarray:
    """Packed vectors as float rows; whole numbers below 2**53 stay exact."""
    return _ints(column, rows).astype(np.float64)


def _ints(column: pa.Array, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int64).reshape(rows, -1)


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, packed, dims, lengths = [], [], [], []
        for k, v in enumerate(batch["embedding"].to_pylist()):
            if None in v:
                continue
            x = np.floor(256 * np.array(v, dtype=np.float64))
            if not np.isfinite(x).all() or (np.abs(x) > 2 ** 31).any():
                continue
            x = x.astype(np.int64)
            length = sum(int(y) * int(y) for y in x) if np.abs(x).max(initial=0) > 2 ** 20 else int(x @ x)
            if length <= LONGEST:
                keep.append(k)
                packed.append(x.tobytes())
                dims.append(len(x))
                lengths.append(length)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch["vec_id"].take(at), batch["label"].take(at), pa.array(dims, pa.int32()), pa.array(lengths, pa.int64()), pa.array(packed, pa.binary())],
                                         names=["vec_id", "label", "dim", "length", "vector"])


def _products(asks: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products: in floats where every partial sum stays below 2**53, else in integers."""
    longest = max(float(np.square(a.astype(np.float64)).sum(axis=1).max(initial=0)) for a in (asks, rows))
    if longest < 2 ** 52:
        return (asks.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return asks @ rows.T


def _search(same: bool, top: int):
    """Best ``top`` rows of a block for each window of its asking anchors."""
    def run(table: pa.Table) -> pa.Table:
        asking = table["low"].is_valid().to_numpy()
        a, b = np.flatnonzero(asking), np.flatnonzero(~asking)
        ids, labels = table["vec_id"].to_numpy(), table["label"].to_numpy()
        b = b[np.argsort(ids[b], kind="stable")]
        out = [], [], [], []
        if len(a) and len(b):
            vectors = table["vector"].combine_chunks()
            rows = _ints(vectors.take(pa.array(b)), len(b))
            low, high, anchor = (table[c].to_pylist() for c in ("low", "high", "anchor"))
            for s in range(0, len(a), 64):
                part = a[s:s + 64]
                scores = _products(_ints(vectors.take(pa.array(part)), len(part)), rows)
                fits = ((labels[b] == labels[part][:, None]) == same) & (ids[b] != ids[part][:, None])
                for k, at in enumerate(part.tolist()):
                    found = np.flatnonzero(fits[k] & (scores[k] >= min(low[at])) & (scores[k] <= max(high[at])))
                    found = found[np.argsort(-scores[k][found], kind="stable")]  # rows stand by vec_id
                    score = scores[k][found]
                    for place, (lo, hi) in enumerate(zip(low[at], high[at])):
                        first, last = np.searchsorted(-score, -hi, "left"), np.searchsorted(-score, -lo, "right")
                        got = found[first:min(last, first + top)]
                        out[0].extend([anchor[at]] * len(got))
                        out[1].extend([place] * len(got))
                        out[2].extend(ids[b[got]].tolist())
                        out[3].extend(scores[k][got].tolist())
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], names=["anchor", "place", "found_id", "score"])
    return run


def _visits(shared, first: bool):
    """Leaves an anchor asks: the nearest, or all others that its windows' annuli meet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            asks = _whole(batch["vector"], batch.num_rows)
            nearest = tree.nearest(asks).tolist()
            if first:
                leaves = nearest
            else:
                leaves = [sorted(set(tree.reach(x, n, np.array(lo, dtype=np.float64), np.array(hi, dtype=np.float64))) - set(near))
                          for x, n, lo, hi, near in zip(asks, batch["length"].to_pylist(), batch["low"].to_pylist(), batch["high"].to_pylist(), nearest)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.list_(pa.int32()))], names=[*batch.schema.names, "leaves"])
    return run


def _and(df: DataFrame, column: str) -> StructType:
    return StructType([*df.schema.fields, *StructType.fromDDL(column).fields])


def _best(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of each window; what cannot be among them goes before the shuffle."""
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


class _Forest:
    """All rows of one vector length, placed in a tree."""

    def __init__(self, rows: DataFrame, total: int, radius: float, dim: int):
        spark = rows.sparkSession
        space = 1 << 30
        chosen = rows.where(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(space)) < int(space * min(1, SAMPLE / 2 / total))).select("vector").limit(SAMPLE).collect()
        ints = np.frombuffer(b"".join(sorted({bytes(r["vector"]) for r in chosen})), dtype=np.int64).reshape(-1, dim).astype(np.float64) if dim else np.zeros((0, 0))
        tree = Tree(_lifted(ints, np.square(ints).sum(axis=1), radius), radius, int(min(LEAVES, total // LEAF)))
        shared = spark.sparkContext.broadcast(tree)  # SAMPLE and LEAVES bound it

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _lifted(_whole(batch["vector"], batch.num_rows), np.array(batch["length"].to_pylist(), dtype=np.float64), radius)
                    leaf = shared.value.place(x, lambda *_: None)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], names=[*batch.schema.names, "leaf"])

        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            least, most = {}, {}

            def seen(node, child, far):
                least[node, child] = np.minimum(least.get((node, child), np.inf), far.min(axis=0))
                most[node, child] = np.maximum(most.get((node, child), 0.0), far.max(axis=0))
            for batch in batches:
                if batch.num_rows:
                    shared.value.place(_lifted(_whole(batch["vector"], batch.num_rows), np.array(batch["length"].to_pylist(), dtype=np.float64), radius), seen)
            flat = [(n, c, p, float(least[n, c][p]), float(most[n, c][p])) for n, c in least for p in range(len(least[n, c]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in flat], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()))], names=["node", "child", "point", "low", "high"])

        self.rows = stored(rows.mapInArrow(place, _and(rows, "leaf int")), "placed")
        tree.low = [np.full((len(p), len(p)), np.inf) for p in tree.points]
        tree.high = [np.full((len(p), len(p)), -np.inf) for p in tree.points]
        if tree.points:  # LEAVES * FAN numbers at most
            for r in (self.rows.select("vector", "length").mapInArrow(ranges, "node int, child int, point int, low double, high double")
                      .groupBy("node", "child", "point").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()):
                tree.low[r["node"]][r["point"], r["child"]], tree.high[r["node"]][r["point"], r["child"]] = r["low"], r["high"]
        self.tree = spark.sparkContext.broadcast(tree)
        self.sizes = stored(self.rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("cuts")), "leaves")

    def _asked(self, asks: DataFrame, first: bool, same: bool, top: int) -> DataFrame:
        visits = asks.mapInArrow(_visits(self.tree, first), _and(asks, "leaves array<int>"))
        visits = visits.withColumn("leaf", F.explode("leaves")).drop("leaves").join(F.broadcast(self.sizes), "leaf")  # LEAVES rows at most
        visits = visits.withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).drop("cuts")
        groups = visits.where("cut = 0").groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / ANCHORS).cast("int").alias("groups"))
        asking = visits.join(F.broadcast(groups), "leaf").select("leaf", "cut", F.pmod(F.xxhash64("anchor"), "groups").cast("int").alias("group"), "vec_id", "label", "vector", "anchor", "low", "high")
        held = (self.rows.join(F.broadcast(self.sizes), "leaf").join(F.broadcast(groups), "leaf")
                .select("leaf", F.pmod(F.xxhash64("vec_id", "vector"), "cuts").cast("int").alias("cut"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "vec_id", "label", "vector",
                        F.lit(None).cast("long").alias("anchor"), F.lit(None).cast("array<long>").alias("low"), F.lit(None).cast("array<long>").alias("high")))
        return asking.unionByName(held).groupBy("leaf", "cut", "group").applyInArrow(_search(same, top), "anchor long, place int, found_id long, score long")

    def search(self, asks: DataFrame, same: bool, top: int) -> DataFrame:
        """``anchor, place, found_id, score, rank``: the best ``top`` rows in every window of every anchor."""
        near = stored(self._asked(asks, True, same, top), "near")
        last = _best(near, top).where(F.col("rank") == top).select("anchor", F.struct("place", "score").alias("reached"))
        bounds = last.groupBy("anchor").agg(F.map_from_entries(F.collect_list("reached")).alias("reached"))  # as many as windows
        narrowed = asks.join(bounds, "anchor", "left").withColumn("low", F.transform("low", lambda x, k: F.greatest(x, F.coalesce(F.col("reached")[k], x)))).select(asks.columns)
        return _best(near.unionByName(self._asked(narrowed, False, same, top)), top)


def mine(vectors: DataFrame, anchors: int = 100, positives: int = 5, negatives: int = 5, least: int = 80) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are rows whose ``vec_id`` is a multiple of ``anchors``; their first ``positives`` rows of the same label each
    get the first ``negatives`` rows of other labels whose score is at least ``least`` percent of the positive's and not
    above it.
    """
    spark = vectors.sparkSession
    rows = vectors.where("vec_id is not null and label is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = stored(rows.mapInArrow(_integers, "vec_id long, label long, dim int, length long, vector binary"), "integers")
    out = None
    for dim, total, longest in sorted(tuple(r) for r in rows.groupBy("dim").agg(F.count(F.lit(1)), F.max("length")).collect()):  # one row per vector length
        forest = _Forest(rows.where(F.col("dim") == dim), total, float(longest) ** 0.5, dim)
        asks = stored(forest.rows.where(F.col("vec_id") % anchors == 0).select("vec_id", "label", "length", "vector").distinct()
                      .withColumn("anchor", F.monotonically_increasing_id()), "anchors")
        whole = lambda x: F.array(F.lit(x).cast("long"))
        near = stored(forest.search(asks.withColumn("low", whole(-2 ** 62)).withColumn("high", whole(2 ** 62)), True, positives), "positives")
        windows = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("found_id").alias("positive_id"), "score"))).alias("w"))  # ``positives`` at most
        # scores of 0 have the window 0, negative ones none
        windows = windows.withColumn("w", F.filter("w", lambda x: x["score"] >= 0)).where(F.size("w") > 0)
        asks = stored(asks.join(windows, "anchor").withColumn("low", F.transform("w", lambda x: F.ceil(x["score"].cast("decimal(20,0)") * least / 100).cast("long"))).withColumn("high", F.col("w.score")), "windows")
        hard = forest.search(asks.drop("w"), False, negatives)
        got = hard.join(asks.select("anchor", F.col("vec_id").alias("anchor_id"), "w"), "anchor").withColumn("p", F.col("w")[F.col("place")]).select(
            "anchor_id", F.col("p.positive_id").alias("positive_id"), "rank", F.col("found_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
