"""Operator 11: prefix trie of conversations, its subtrees summed along an Euler tour.

Equal prefixes are equal position-mixed hashes of their turns (128 bits), so a node is one group, counted map-side. A node
is named by its smallest member and its depth. Siblings stand by smallest member, hence the first child carries its
parent's member on. Every node has an enter and an exit arc; the arc after each is known from the first child, the next
sibling or the parent. Enter arcs of one member follow each other in the tour, as do exit arcs up to the next branching:
such runs, of ``RUN`` arcs at most, are the elements of the list. The list is ranked by removing, round after round, the
elements whose random number is below both neighbours' (a third of them, one shuffle by element) and putting them back in
reverse order, until ``REST`` elements are left. What is summed from an arc to the tour's end gives arc positions, and the
difference between a node's two arcs gives its subtree's leaves and savings.

Long conversations: turns are numbered within range partitions and the numbers before each partition are added, hashes are
summed in runs with the totals of earlier runs, so no conversation stands in one task. Prefixes of many members: groups
aggregate map-side; parents with many children, of which there are ``HEAVY`` at most, are joined by broadcast. The members
that end at a node are hashed in order from pieces of range partitions.

Defined results: null role or text is empty; turns are ordered by turn, null first, equal turns by a hash of role and text,
and repeated rows are turns of their own; rows without ``conv_id`` take no part; a table without conversations gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, stored

#: Turns of one run, elements left when rounds end, and one over the share of rows that makes a parent heavy.
RUN, REST, HEAVY = 4096, 4096, 10_000
EMPTY = hashlib.sha256(b"").hexdigest()
_WORD = r"[^\x20\x09-\x0D]+"


def _numbered(turns: DataFrame) -> DataFrame:
    """``conv_id, i, m, words``: turns numbered from 1 within their conversation."""
    spark = turns.sparkSession
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(_WORD)).cast("long").alias("words"),
        F.unhex(F.md5(F.concat(F.md5(F.coalesce("role", F.lit(""))), F.md5(F.coalesce("text", F.lit("")))))).alias("m"))
    order = ["conv_id", "turn", "m"]
    ranged = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("piece", F.spark_partition_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch["conv_id"].to_numpy()
            start = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            i = np.arange(1, len(conv) + 1) - np.repeat(start, np.diff(np.r_[start, len(conv)]))
            if last == conv[0]:
                i[:start[1] if len(start) > 1 else None] += count
            last, count = conv[-1], int(i[-1])
            yield pa.RecordBatch.from_arrays([batch["conv_id"], pa.array(i), batch["piece"], batch["m"], batch["words"]], names=["conv_id", "i", "piece", "m", "words"])

    numbered = stored(ranged.select("conv_id", "piece", "m", "words").mapInArrow(number, "conv_id long, i long, piece int, m binary, words long"), "turns")
    # a conversation goes on over partition borders only: one carried number for each partition, at most
    carry, before, carried = [], None, 0
    for piece, first, end in numbered.groupBy("piece").agg(F.min("conv_id"), F.max(F.struct("conv_id", "i"))).orderBy("piece").collect():
        goes_on = first == before
        if goes_on:
            carry.append((piece, first, carried))
        carried = end["i"] + (carried if goes_on and end["conv_id"] == first else 0)
        before = end["conv_id"]
    more = F.broadcast(spark.createDataFrame(carry, "piece int, conv_id long, more long"))
    return numbered.join(more, ["piece", "conv_id"], "left").select("conv_id", (F.col("i") + F.coalesce("more", F.lit(0))).alias("i"), "m", "words")


def reseeded(turns: DataFrame) -> DataFrame:
    """``conv_id, d, m, words, turns``: each conversation begins with the first turns of conversation ``c - c % 20``.

    A conversation without turns left has one row without ``d``.
    """
    own = _numbered(turns)
    sizes = own.groupBy("conv_id").agg(F.max("i").alias("size"))
    convs = stored(sizes.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).withColumn("base", F.col("conv_id") - F.col("conv_id") % 20)
                   .join(sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size")), "base", "left")
                   .select("conv_id", "size", "h", "base", F.least("h", F.coalesce("base_size", F.lit(0))).alias("head"))
                   .withColumn("turns", F.col("head") + F.greatest(F.col("size") - F.col("h"), F.lit(0))), "convs")
    heads = convs.join(own.where("i <= 3").select(F.col("conv_id").alias("base"), "i", "m", "words"), "base").where("i <= h").select("conv_id", F.col("i").alias("d"), "m", "words", "turns")
    # sizes are unique by conversation, so only the turns' side can be hot; its rows are spread by run first
    runs = convs.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("size") / RUN).cast("long")))).select("conv_id", "run", "h", "head", "turns")
    tails = (own.withColumn("run", (F.col("i") / RUN).cast("long")).join(runs, ["conv_id", "run"]).where("i > h")
             .select("conv_id", (F.col("i") - F.col("h") + F.col("head")).alias("d"), "m", "words", "turns"))
    none = convs.where("turns = 0").select("conv_id", F.lit(None).cast("long").alias("d"), F.lit(None).cast("binary").alias("m"), F.lit(0).cast("long").alias("words"), "turns")
    return heads.unionByName(tails).unionByName(none)


def _prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, d, a, b, qa, qb, words, ends``: hashes of each prefix, and of the one a turn shorter."""
    one = (turns.where("d is not null").withColumn("run", F.floor((F.col("d") - 1) / RUN))
           .withColumn("ta", F.xxhash64("m", "d")).withColumn("tb", F.xxhash64("d", "m")))
    totals = one.groupBy("conv_id", "run").agg(F.expr("bit_xor(ta)").alias("ra"), F.expr("bit_xor(tb)").alias("rb"), F.max("turns").alias("t")).where(F.col("t") > RUN)
    earlier = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("conv_id", "run", F.expr("bit_xor(ra)").over(earlier).alias("ca"), F.expr("bit_xor(rb)").over(earlier).alias("cb"))
    so_far = Window.partitionBy("conv_id", "run").orderBy("d")
    zero = F.lit(0).cast("long")
    return (one.withColumn("a", F.expr("bit_xor(ta)").over(so_far)).withColumn("b", F.expr("bit_xor(tb)").over(so_far)).join(carry, ["conv_id", "run"], "left")
            .withColumn("a", F.col("a").bitwiseXOR(F.coalesce("ca", zero))).withColumn("b", F.col("b").bitwiseXOR(F.coalesce("cb", zero)))
            .select("conv_id", "d", "a", "b", F.col("a").bitwiseXOR(F.col("ta")).alias("qa"), F.col("b").bitwiseXOR(F.col("tb")).alias("qb"), "words", (F.col("d") == F.col("turns")).alias("ends")))


def _with_parents(nodes: DataFrame) -> DataFrame:
    """Adds ``parent_conv_id``. Members are summed over the nodes, so few parents can have many children."""
    total = nodes.agg(F.sum("n_convs")).first()[0]
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("qa"), F.col("b").alias("qb"), F.col("conv_id").alias("parent_conv_id"), "n_convs")
    heavy = parents.where(F.col("n_convs") > total / HEAVY).drop("n_convs")  # fewer than HEAVY nodes
    light = parents.where(F.col("n_convs") <= total / HEAVY).drop("n_convs")
    key = ["depth", "qa", "qb"]
    under = nodes.join(F.broadcast(heavy), key, "left")
    rest = under.where("parent_conv_id is null").drop("parent_conv_id").join(light, key, "left")
    return under.where("parent_conv_id is not null").unionByName(rest)


def _with_siblings(nodes: DataFrame) -> DataFrame:
    """``conv_id, depth, next_conv``: the next sibling of every node that has one, from sorted range partitions."""
    spark = nodes.sparkSession
    order = ["depth", "parent_conv_id", "conv_id"]
    ranged = stored(nodes.where("depth > 0").select(*order).repartitionByRange(partitions(spark), *order).withColumn("piece", F.spark_partition_id()), "siblings")
    ends = ranged.groupBy("piece").agg(F.min(F.struct(*order)).alias("first"), F.max(F.struct(*order)).alias("last")).orderBy("piece").collect()  # one row per partition
    over = [(a["last"]["conv_id"], a["last"]["depth"], b["first"]["conv_id"]) for a, b in zip(ends, ends[1:]) if tuple(a["last"])[:2] == tuple(b["first"])[:2]]
    within = ranged.withColumn("next_conv", F.lead("conv_id").over(Window.partitionBy("piece", "depth", "parent_conv_id").orderBy("conv_id"))).where("next_conv is not null").select("conv_id", "depth", "next_conv")
    return within.unionByName(spark.createDataFrame(over, "conv_id long, depth long, next_conv long"))


def _key(conv: str | Column, code: Column) -> Column:
    """Name of a list element: the member and depth of its first arc, even numbers enter and odd ones exit."""
    return F.struct(F.col(conv).alias("conv") if isinstance(conv, str) else conv.alias("conv"), code.cast("long").alias("code"))


def _runs(nodes: DataFrame) -> DataFrame:
    """Every node with the elements that hold its two arcs, and how many arcs of the element stand before them."""
    w = Window.partitionBy("conv_id", "run").orderBy("depth")
    below, all_ = w.rowsBetween(Window.currentRow, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    start = F.when((F.col("n_children") > 1) | (F.col("depth") == F.col("bottom")), F.col("depth"))
    return (nodes.withColumn("run", F.floor(F.col("depth") / RUN))
            .withColumn("top", F.min("depth").over(all_)).withColumn("bottom", F.max("depth").over(all_))
            .withColumn("saved_before", F.coalesce(F.sum("own_saved").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("exit_from", F.min(start).over(below))
            .withColumn("enter", _key("conv_id", F.col("top") * 2)).withColumn("exit", _key("conv_id", F.col("exit_from") * 2 + 1)))


def _elements(runs: DataFrame, siblings: DataFrame) -> DataFrame:
    """``id, succ, n, leaves, saved``: the tour as a linked list of runs; the last element has no ``succ``."""
    none = F.lit(None).cast("struct<conv:bigint,code:bigint>")
    enters = (runs.where("depth = bottom").withColumn("n", F.col("bottom") - F.col("top") + 1)
              .select(F.col("enter").alias("id"), F.when(F.col("n_children") > 0, _key("first_child", (F.col("depth") + 1) * 2)).otherwise(F.col("exit")).alias("succ"),
                      "n", (F.col("n_children") == 0).cast("long").alias("leaves"), (F.col("saved_before") + F.col("own_saved")).alias("saved")))
    tops = (runs.groupBy("conv_id", "run", "exit").agg(F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n"), F.min_by("parent_conv_id", "depth").alias("parent_conv_id"))
            .join(siblings, ["conv_id", "depth"], "left"))
    exits = tops.select(F.col("exit").alias("id"),
                        F.when(F.col("depth") == 0, none).when(F.col("next_conv").isNotNull(), _key("next_conv", F.col("depth") * 2)).otherwise(_key("parent_conv_id", F.col("depth") * 2 - 1)).alias("succ"),
                        "n", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    return enters.unionByName(exits)


def rank(elements: DataFrame) -> DataFrame:
    """``id, n, leaves, saved``: sums of the weights of a linked list from each element to the end.

    An element is taken out where its number of the round is below that of the element before and after it, so no two
    neighbours leave together. Its neighbours are told in one shuffle, in which an element meets three rows at most.
    """
    spark = elements.sparkSession
    weights = ["n", "leaves", "saved"]
    before = elements.where("succ is not null").select(F.col("succ").alias("id"), F.col("id").alias("pred"))
    live, gone, rounds = stored(elements.join(before, "id", "left").select("id", "pred", "succ", *weights), "list"), [], 0
    while (left := live.count()) > REST:
        number = lambda c: F.xxhash64(f"{c}.conv", f"{c}.code", F.lit(rounds))
        out = F.coalesce((number("id") < number("pred")) & (number("id") < number("succ")), F.lit(False)) & F.col("pred").isNotNull() & F.col("succ").isNotNull()
        live = live.withColumn("out", out)
        stay, leave = live.where("not out").drop("out"), live.where("out").drop("out")
        no_link, zero = F.lit(None).cast(live.schema["id"].dataType), [F.lit(0).cast("long").alias(w) for w in weights]
        told = (stay.select("id", F.lit(True).alias("stays"), "pred", "succ", no_link.alias("new_pred"), no_link.alias("new_succ"), *weights)
                .unionByName(leave.select(F.col("pred").alias("id"), F.lit(False).alias("stays"), no_link.alias("pred"), no_link.alias("succ"), no_link.alias("new_pred"), F.col("succ").alias("new_succ"), *weights))
                .unionByName(leave.select(F.col("succ").alias("id"), F.lit(False).alias("stays"), no_link.alias("pred"), no_link.alias("succ"), F.col("pred").alias("new_pred"), no_link.alias("new_succ"), *zero)))
        one = told.groupBy("id").agg(*[F.max(c).alias(c) for c in ("pred", "succ", "new_pred", "new_succ")], *[F.sum(w).alias(w) for w in weights])
        gone.append(stored(leave.select("id", "succ", *weights), "gone"))
        live = stored(one.select("id", F.coalesce("new_pred", "pred").alias("pred"), F.coalesce("new_succ", "succ").alias("succ"), *weights), "list")
        rounds += 1
    # REST elements at most, whatever the input: followed from the end
    rows = {tuple(r["id"]): r for r in live.collect()}
    prior = {tuple(r["succ"]): k for k, r in rows.items() if r["succ"] is not None}
    at, sums, ranked = next((k for k, r in rows.items() if r["succ"] is None), None), [0, 0, 0], []
    while at is not None:
        sums = [s + rows[at][w] for s, w in zip(sums, weights)]
        ranked.append((at, *sums))
        at = prior.get(at)
    done = spark.createDataFrame(ranked, "id struct<conv:bigint,code:bigint>, n long, leaves long, saved long")
    for leave in reversed(gone):
        after = done.select(F.col("id").alias("succ"), *[F.col(w).alias(f"{w}_after") for w in weights])
        done = done.unionByName(stored(leave.join(after, "succ").select("id", *[(F.col(w) + F.col(f"{w}_after")).alias(w) for w in weights]), "ranked"))
    return done


def _ends_digests(ends: DataFrame) -> DataFrame:
    """``depth, a, b, ends_sha256`` of ``depth, a, b, conv_id``: ids in order, hashed as they stream by."""
    spark = ends.sparkSession
    key = ["depth", "a", "b"]
    ranged = ends.repartitionByRange(partitions(spark), *key, "conv_id").sortWithinPartitions(*key, "conv_id")
    names, types = [*key, "conv_id", "ids"], "depth long, a long, b long, conv_id long, ids string"

    def cut(batch: pa.RecordBatch) -> tuple[list, np.ndarray]:
        columns = [batch[c].to_numpy() for c in key]
        new = np.zeros(batch.num_rows, dtype=bool)
        new[:1] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        return columns, np.flatnonzero(new)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (depth, a, b), start = cut(batch)
            conv = batch["conv_id"].to_numpy()
            text = [",".join(map(str, part.tolist())) for part in np.split(conv, start[1:])] if len(conv) else []
            yield pa.RecordBatch.from_arrays([pa.array(x[start]) for x in (depth, a, b, conv)] + [pa.array(text, pa.string())], names=names)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            keys = list(zip(*[batch[c].to_pylist() for c in key]))
            out = []
            for k, ids in zip(keys, batch["ids"].to_pylist()):
                if k == now:
                    state.update(b"," + ids.encode())
                    continue
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = k, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip([*key, "ends_sha256"], r)) for r in out], schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip([*key, "ends_sha256"], (*now, state.hexdigest())))], schema=schema)

    schema = pa.schema([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])
    return (ranged.mapInArrow(pieces, types).repartition(*key).sortWithinPartitions(*key, "conv_id")
            .select(*key, "ids").mapInArrow(digests, "depth long, a long, b long, ends_sha256 string"))


def prefix_trie(turns: DataFrame, reseed: bool = True) -> DataFrame:
    """One row per distinct prefix of ``conv_id, turn, role, text``; see the module.

    ``enter_at`` and ``exit_at`` are the places of a node's arcs in the tour, from 0. Without ``reseed`` conversations are
    taken as they are.
    """
    spark = turns.sparkSession
    if reseed:
        convs = reseeded(turns)
    else:
        own = _numbered(turns)
        convs = own.join(own.groupBy("conv_id").agg(F.max("i").alias("turns")), "conv_id").select("conv_id", F.col("i").alias("d"), "m", "words", "turns")
    convs = stored(convs, "reseeded")
    prefixes = stored(_prefixes(convs), "prefixes")
    zero = F.lit(0).cast("long")
    members = convs.where("d is null or d = 1")
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id", "n_convs", zero.alias("words"), F.lit(None).cast("long").alias("qa"), F.lit(None).cast("long").alias("qb"))
    groups = (prefixes.groupBy(F.col("d").alias("depth"), "a", "b")
              .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), F.max("qa").alias("qa"), F.max("qb").alias("qb"))
              .select("depth", "a", "b", "conv_id", "n_convs", "words", "qa", "qb"))
    named = stored(root.unionByName(groups), "nodes")
    if named.isEmpty():
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, enter_at long, exit_at long")
    nodes = stored(_with_parents(named).select("depth", "a", "b", "conv_id", "parent_conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("own_saved")), "nodes")
    children = (nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
                .agg(F.count(F.lit(1)).alias("n_children"), F.min("conv_id").alias("first_child")))
    runs = stored(_runs(nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", zero)))
                  .select("conv_id", "depth", "parent_conv_id", "a", "b", "n_convs", "n_children", "first_child", "own_saved", "run", "top", "bottom", "saved_before", "exit_from", "enter", "exit"), "runs")
    ranked = rank(_elements(runs, _with_siblings(nodes)))
    length = 2 * runs.count()
    at = lambda arc: ranked.select(F.col("id").alias(arc), *[F.col(w).alias(f"{arc}_{w}") for w in ("n", "leaves", "saved")])
    ends = convs.where("d is null").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id").unionByName(prefixes.where("ends").select(F.col("d").alias("depth"), "a", "b", "conv_id"))
    return (runs.join(at("enter"), "enter").join(at("exit"), "exit").join(_ends_digests(ends), ["depth", "a", "b"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("enter_leaves") - F.col("exit_leaves")).alias("n_leaves"),
                    (F.col("enter_saved") - F.col("saved_before") - F.col("exit_saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
                    (length - F.col("enter_n") + F.col("depth") - F.col("top")).alias("enter_at"), (length - F.col("exit_n") + F.col("exit_from") - F.col("depth")).alias("exit_at")))
