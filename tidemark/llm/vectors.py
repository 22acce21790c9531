"""Operator 10: near-duplicate embeddings by product quantisation.

A coarse quantiser puts every vector into one inverted list; the rest to the list's centre is coded by subspaces. Each
vector also asks the lists nearest to it. In a list, table look-ups give the inner product with every coded vector; the
code's own error, stored with it, bounds how far the look-up can be off, so no pair over the limit is lost there, and
what remains is checked by exact cosines. Lists are worked in blocks of bounded size, and a block returns counts and the
edges of its components, never all its pairs. A link found from one end only counts at both.

Defined results: vectors that are null, empty, zero or hold null or non-finite parts have no links and are their own
component; vectors link with vectors of the same length only; rows with null ``vec_id`` link with nothing and are kept;
rows of equal vectors link with each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.graph import components

#: Rows the quantisers are fitted on at most; every row is indexed.
SAMPLE = 8192
#: Coarse lists at most, lists asked by each vector, subspaces and codes of each.
LISTS, PROBES, SUBSPACES, CODES = 1024, 12, 8, 64
#: Vectors of a list, and asking vectors, worked at a time.
BLOCK = 1024
LEAST = 0.95


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centres of a bounded sample, from evenly spread rows on."""
    k = min(k, len(x))
    centre = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(x, centre)
        for j in np.unique(own):
            centre[j] = x[own == j].mean(axis=0)
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return (np.square(centre).sum(axis=1) - 2 * x @ centre.T).argmin(axis=1)


class Quantiser:
    """Coarse centres and one codebook per subspace, fitted on unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int, probes: int):
        self.probes = probes
        self.coarse = kmeans(sample, lists)
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        self.cuts = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        self.books = [kmeans(rest[:, a:b], CODES) for a, b in zip(self.cuts, self.cuts[1:])]

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the length of what they leave out of each vector."""
        rest = x - self.coarse[own]
        codes = np.stack([nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], axis=1).astype(np.uint8)
        told = np.concatenate([book[c] for book, c in zip(self.books, codes.T)], axis=1)
        return codes, np.sqrt(np.square(rest - told).sum(axis=1))

    def look_up(self, ask: np.ndarray, own: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric inner products of whole vectors with the coded ones of one list."""
        out = np.repeat((ask @ self.coarse[own])[:, None], len(codes), axis=1)
        for m, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
            out += (ask[:, a:b] @ book.T)[:, codes[:, m]]
        return out


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, units, dims = [], [], []
        for v in batch.column(1).to_pylist():
            x = np.array(v, dtype=np.float64) if v and None not in v else np.zeros(0)
            with np.errstate(over="ignore", invalid="ignore"):
                scale = np.abs(x).max() if len(x) else 0.0
                ok = np.isfinite(x).all() and scale > 0
                unit = x / scale if ok else x
                unit = unit / np.sqrt(unit @ unit) if ok else None
            units.append(None if unit is None else unit.tobytes())
            keys.append(None if unit is None else xxhash.xxh3_128_digest(units[-1]))
            dims.append(0 if unit is None else len(unit))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], names=["vec_id", "class", "dim", "unit"])


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.float64).reshape(batch.num_rows, -1)
            score = np.square(q.coarse).sum(axis=1) - 2 * x @ q.coarse.T
            near = np.argsort(score, axis=1, kind="stable")[:, :q.probes]
            codes, left = q.encode(x, near[:, 0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left)],
                                             names=["node", "copies", "unit", "near", "codes", "left"])
    return run


def _search(shared):
    def run(table: pa.Table) -> pa.Table:
        q, own = shared.value, table["list"][0].as_py()
        node, ask, copies = (table[c].to_numpy() for c in ("node", "ask", "copies"))
        x = np.frombuffer(b"".join(table["unit"].to_pylist()), dtype=np.float64).reshape(table.num_rows, -1)
        a, b = np.flatnonzero(ask), np.flatnonzero(~ask)
        n, back, root = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64), {}

        def find(v: int) -> int:
            while (up := root.get(v, v)) != v:
                root[v] = root.get(up, up)
                v = up
            return v

        if len(a) and len(b):
            codes = np.frombuffer(b"".join([table["codes"][int(i)].as_py() for i in b]), dtype=np.uint8).reshape(len(b), -1)
            left = table["left"].to_numpy()[b]
            home = table["home"].to_numpy()
            asked = np.array([table["near"][int(i)].as_py() for i in b], dtype=np.int64)
            for s in range(0, len(a), 256):
                part = a[s:s + 256]
                i, j = np.nonzero(q.look_up(x[part], own, codes) >= LEAST - left - 1e-9)
                other = node[part[i]] != node[b[j]]
                i, j = i[other], j[other]
                good = np.einsum("ij,ij->i", x[part[i]], x[b[j]]) >= LEAST
                i, j = i[good], j[good]
                n[s:s + len(part)] += np.bincount(i, weights=copies[b[j]], minlength=len(part)).astype(np.int64)
                # the other end counts the link itself where it asks this one's own list, else it is told here
                alone = ~(asked[j] == home[part[i]][:, None]).any(axis=1)
                back += np.bincount(j[alone], weights=copies[part[i[alone]]], minlength=len(b)).astype(np.int64)
                for u, v in zip(node[part[i]].tolist(), node[b[j]].tolist()):
                    u, v = find(u), find(v)
                    if u != v:
                        root[max(u, v)] = min(u, v)
        linked = [(v, find(v)) for v in list(root)]
        links = [*zip(node[a][n > 0].tolist(), n[n > 0].tolist()), *zip(node[b][back > 0].tolist(), back[back > 0].tolist())]
        return pa.table({"node": pa.array([*(v for v, _ in links), *(v for v, _ in linked)], pa.int64()), "other": pa.array([*[None] * len(links), *(r for _, r in linked)], pa.int64()),
                         "n": pa.array([*(c for _, c in links), *[0] * len(linked)], pa.int64())})
    return run


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vec_id, embedding``."""
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    units = stored(vectors.mapInArrow(_unit, "vec_id long, class binary, dim int, unit binary"), "units")
    nodes = stored(units.where("class is not null and vec_id is not null").groupBy("class")
                   .agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("dim").alias("dim"), F.first("unit").alias("unit")), "nodes")
    found = None
    sizes = nodes.groupBy("dim").count().collect()  # one row per vector length
    for dim, total in sorted(sizes):
        mine = nodes.where(F.col("dim") == dim)
        space = 1 << 30
        sample = mine.where(F.pmod(F.xxhash64("class"), F.lit(space)) < int(space * min(1, SAMPLE / total))).select("unit").limit(2 * SAMPLE).collect()
        if not sample:
            sample = mine.select("unit").limit(SAMPLE).collect()
        fitted = Quantiser(np.frombuffer(b"".join(bytes(r["unit"]) for r in sorted(sample)), dtype=np.float64).reshape(len(sample), dim), int(min(LISTS, max(1, total ** 0.5))), PROBES)
        shared = spark.sparkContext.broadcast(fitted)
        placed = stored(mine.select("node", "copies", "unit").mapInArrow(_place(shared), "node long, copies long, unit binary, near array<int>, codes binary, left double"), "placed")
        lists = placed.groupBy(F.col("near")[0].alias("list")).agg(F.count(F.lit(1)).alias("size"))
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        # a list of many vectors is cut by hash; every asking vector meets each cut, and is itself in one of as many groups
        held = placed.withColumn("list", F.col("near")[0]).join(lists, "list").select("list", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("cut"), F.lit(False).alias("ask"), "node", "copies", "unit", "codes", "left", F.lit(None).cast("int").alias("home"), "near")
        asking = (placed.select("node", "copies", "unit", F.col("near")[0].alias("home"), F.explode("near").alias("list")).join(lists, "list").withColumn("cut", F.explode(F.sequence(F.lit(0), blocks - 1)))
                  .select("list", "cut", F.lit(True).alias("ask"), "node", "copies", "unit", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("left"), "home", F.lit(None).cast("array<int>").alias("near")))
        asks = asking.groupBy("list", "cut").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("groups"))
        asking = asking.join(asks, ["list", "cut"]).withColumn("group", F.pmod(F.xxhash64("node", F.lit(1)), F.col("groups")).cast("int")).drop("groups")
        held = held.join(asks, ["list", "cut"]).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
        got = held.unionByName(asking).groupBy("list", "cut", "group").applyInArrow(_search(shared), "node long, other long, n long")
        found = got if found is None else found.unionByName(got)
    if found is None:
        found = spark.createDataFrame([], "node long, other long, n long")
    found = stored(found, "found")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    parts = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    of_class = (nodes.select("class", "node", "copies").join(counts, "node", "left").join(parts, "node", "left")
                .select("class", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")))
    out = units.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("class")).alias("class")).join(of_class, "class", "left")
    return (out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
