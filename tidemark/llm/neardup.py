"""Operator 8: near-duplicates by banded MinHash, odd sketches and a check on whole shingle sets.

1. One pass gives each document the number of its shingles, a hash of the whole set, band keys of its MinHash samples,
   and an odd sketch: the samples folded into a parity bitmap. Documents of equal sets become one node.
2. Within a band bucket every node is paired with the bucket's smallest node only. Pairs whose sketches differ in few
   bits (XOR, population count) are checked on their whole sets; what links is joined to components. A second odd sketch
   folds the whole set: it cannot differ in more bits than the sets in elements, which is a sharp bound on short texts,
   where samples are a blunt one.
3. Buckets that still hold several components are compared in full across components, sketch against sketch, in blocks
   of bounded size; only pairs that pass are written and checked. So no link between components is lost, and large
   groups of copies never become all their pairs.

Two texts at a Jaccard similarity of 0.75 share a bucket with probability 1 - (1 - 0.75^4)^32 > 0.99999, and the bound
on sketches is six deviations wide.

Defined results: null, empty and blank texts have no shingles and link with nothing; texts under five words have one;
rows with null ``doc_id`` link with nothing, get a null component and are kept; repeated rows share a component and each
has its row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER_BLANK, U64, WordHashes, mixed, raw, shingles, stored
from tidemark.llm.graph import components

BANDS, BAND_ROWS, SKETCH_BITS, WHOLE_BITS = 32, 4, 512, 1024
SAMPLES = BANDS * BAND_ROWS
#: Least similarity, in hundredths.
LEAST = 75
#: Nodes compared at a time in a bucket of several components.
BLOCK = 512
#: Ids that are broadcast at most to pick rows; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_MUL, _ADD = (mixed(np.arange(1, SAMPLES + 1, dtype=U64) * U64(k)) | U64(1) for k in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03))


def sketch_bound() -> int:
    """Differing bits up to which two sketches may belong to sets of the least similarity, six deviations below it."""
    j = LEAST / 100
    low = j - 6 * sqrt(j * (1 - j) / SAMPLES)
    return int(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * SAMPLES * (1 - low)))) + 1


def estimated_similarity(differing: int) -> float:
    """Similarity that a number of differing sketch bits stands for."""
    x = min(2 * differing / SKETCH_BITS, 1 - 1e-9)
    return max(0.0, 1 + SKETCH_BITS / (4 * SAMPLES) * log(1 - x))


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """Samples of each non-empty set: the least of a random linear map of its hashes, for each of ``SAMPLES`` maps."""
    out = np.empty((len(sets), SAMPLES), dtype=U64)
    all_ = np.concatenate(sets)
    start = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    for k in range(SAMPLES):
        out[:, k] = np.minimum.reduceat(all_ * _MUL[k] + _ADD[k], start)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    key = np.broadcast_to(np.arange(BANDS, dtype=U64), (len(samples), BANDS)).copy()
    for r in range(BAND_ROWS):
        key = mixed(key * U64(0x9E3779B97F4A7C15) + samples[:, r::BAND_ROWS])
    return key


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the (number, sample) pairs, as words of 64 bits."""
    bit = (mixed(samples + np.arange(SAMPLES, dtype=U64) * U64(0xA24BAED4963EE407)) % U64(SKETCH_BITS)).astype(np.int64)
    count = np.zeros((len(samples), SKETCH_BITS), dtype=np.uint8)
    np.add.at(count, (np.arange(len(samples))[:, None], bit), 1)
    return np.packbits(count & 1, axis=1).view("<u8")


def whole_sketch(s: np.ndarray) -> np.ndarray:
    """Parity bitmap of a whole set: two of them differ in no more bits than the sets in elements."""
    return np.packbits((np.bincount((s >> U64(40)).astype(np.int64) % WHOLE_BITS, minlength=WHOLE_BITS) & 1).astype(np.uint8)).view("<i8")


def set_of(text: bytes, hashes: WordHashes) -> np.ndarray:
    return shingles(hashes.of(text.translate(LOWER_BLANK).split()))


SIGNED = "doc_id long, n_shingles long, class binary, bands array<long>, sketch array<long>, whole array<long>"
_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())), ("whole", pa.list_(pa.int64()))])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()

    def rows(ids: list, sets: list) -> pa.RecordBatch:
        full = [i for i, s in enumerate(sets) if len(s)]
        samples = minhash([sets[i] for i in full]) if full else np.empty((0, SAMPLES), U64)
        bands, sketch = [None] * len(sets), [None] * len(sets)
        for i, b, s in zip(full, band_keys(samples).view(np.int64), odd_sketch(samples).view(np.int64)):
            bands[i], sketch[i] = b, s
        cols = [ids, [len(s) for s in sets], [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], bands, sketch, [whole_sketch(s) if len(s) else None for s in sets]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _SIGNED.types)], schema=_SIGNED)

    for batch in batches:
        ids, sets, size = [], [], 0
        for doc, text in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
            ids.append(doc), sets.append(set_of(text, hashes))
            size += len(sets[-1])
            if size >= 1 << 18 or len(ids) >= 512:
                yield rows(ids, sets)
                ids, sets, size = [], [], 0
        if ids:
            yield rows(ids, sets)


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of whole texts to the pairs whose shingle sets are similar enough."""
    hashes = WordHashes()
    kept: tuple = (None, None)
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        good = []
        for i, (left, right) in enumerate(zip(raw(batch.column(2)), raw(batch.column(3)))):
            if kept[0] != left:
                kept = (left, set_of(left, hashes))
            other = set_of(right, hashes)
            shared = len(kept[1]) + len(other) - len(np.union1d(kept[1], other))
            if 100 * shared >= LEAST * (len(kept[1]) + len(other) - shared):
                good.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64())], names=["a", "b"])


def _compare(table: pa.Table) -> pa.Table:
    """A block of a bucket: pairs from different components whose sketches and sizes allow the least similarity."""
    bound = sketch_bound()
    node, comp, size, chunk = (table[c].to_numpy() for c in ("node", "component", "n_shingles", "chunk"))
    sketch, whole = (np.array(table[c].to_pylist(), dtype=np.int64).view(U64) for c in ("sketch", "whole"))
    left = np.flatnonzero(chunk == chunk.min())
    right = np.flatnonzero(chunk == chunk.max())
    found_a, found_b = [], []
    for i in left:
        differ = np.bitwise_count(sketch[right] ^ sketch[i]).sum(axis=1, dtype=np.int64)
        ok = (differ <= bound) & (comp[right] != comp[i]) & (100 * np.minimum(size[right], size[i]) >= LEAST * np.maximum(size[right], size[i]))
        ok[ok] = (100 + LEAST) * np.bitwise_count(whole[right[ok]] ^ whole[i]).sum(axis=1, dtype=np.int64) <= (100 - LEAST) * (size[right[ok]] + size[i])
        ok &= (node[right] > node[i]) | (chunk[right] != chunk[i])
        found_a.append(np.full(ok.sum(), node[i])), found_b.append(node[right][ok])
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def pick(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` by a one-column table of ``doc_id``: ``left_semi`` or ``left_anti``, broadcast where the ids are few."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", how)


def _linked(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of candidate ``a, b``, those that pass sketches, sizes and the check on whole texts; stored."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"), F.col("whole").alias(f"w_{x}"))
    differ = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, a: s + a)
    close = stored(pairs.join(side("a"), "a").join(side("b"), "b")
                   .where(100 * F.least("n_a", "n_b") >= LEAST * F.greatest("n_a", "n_b")).where((100 + LEAST) * differ("w_a", "w_b") <= (100 - LEAST) * (F.col("n_a") + F.col("n_b"))).where(differ("s_a", "s_b") <= sketch_bound()).select("a", "b"), "close")
    need = stored(close.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "needed")
    texts = stored(pick(docs, need, "left_semi"), "texts")
    both = (close.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
            .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb"))
    return stored(both.mapInArrow(_check, "a long, b long").distinct(), "checked")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``doc_id, text``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(docs.mapInArrow(_sign, SIGNED), "signed")
    classes = (signed.where("class is not null and doc_id is not null").groupBy("class")
               .agg(F.min("doc_id").alias("node"), F.min_by(F.struct("n_shingles", "bands", "sketch", "whole"), "doc_id").alias("s")))
    nodes = stored(classes.select("class", "node", "s.*"), "nodes")
    bands = nodes.select("node", F.explode("bands").alias("band"))
    shared = stored(bands.groupBy("band").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    members = stored(bands.join(shared, "band"), "members")
    first = members.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    links = _linked(docs, nodes, first)
    parts = stored(components(links), "parts")

    placed = members.join(parts, "node", "left").select("band", "n", "node", F.coalesce("component", "node").alias("component"))
    mixed_ = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
    # members beyond one block: each meets every block of its bucket
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    cut = (placed.join(mixed_, "band").withColumn("chunk", F.pmod(F.xxhash64("node"), blocks).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).join(nodes.select("node", "n_shingles", "sketch", "whole"), "node")
           .select("band", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "component", "n_shingles", "sketch", "whole"))
    second = cut.groupBy("band", "i", "j").applyInArrow(_compare, "a long, b long").distinct().join(first, ["a", "b"], "left_anti")
    more = _linked(docs, nodes, second)
    if not more.isEmpty():
        at = lambda x: parts.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
        merged = components(more.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")))
        whole = parts.unionByName(more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(parts, "node", "left_anti").select("node", F.col("node").alias("component")))
        parts = (whole.join(merged.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left")
                 .select("node", F.coalesce("root", "component").alias("component")))
    of_class = nodes.join(parts, "node", "left").select("class", F.coalesce("component", "node").alias("component_id"))
    out = signed.join(of_class, "class", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
