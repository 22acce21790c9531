"""The prefix trie against plain dictionaries."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from tidemark.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def md5(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def plain_trie(rows, reseed=True):
    convs = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            convs[conv].append((turn, role or "", text or ""))
    order = lambda t: (t[0] is not None, t[0] or 0, md5(md5(t[1]) + md5(t[2])))
    convs = {c: [t[1:] for t in sorted(v, key=order)] for c, v in convs.items()}
    told = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4 if reseed else 0
        told[c] = (*convs.get(c - int(math.fmod(c, 20)), [])[:h], *turns[h:])
    members, kids = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(told):
        for d in range(len(told[c]) + 1):
            members[told[c][:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = own + sum(saved[k] for k in kids[p])
    return sorted((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in members[p] if told[c] == p).encode()).hexdigest()) for p in members)


def small_rows():
    rng = random.Random(3)
    rows = [(c, rng.choice([None, 0, 1, 2, 3]), rng.choice(["u", None, ""]), rng.choice(["a b", "", None, "c"]))
            for c in [*range(-30, 200), None] for _ in range(rng.choice([0, 1, 2, 2, 5]))]
    return rows + [(c, k, "u", f"x y{k // 3}") for c, n in ((7, 300), (27, 200)) for k in range(n)]


@pytest.mark.parametrize("reseed", [True, False])
def test_equals_plain_trie_in_short_runs_and_many_rounds(spark, monkeypatch, reseed):
    for name, value in (("RUN", 8), ("REST", 40), ("HEAVY", 5)):
        monkeypatch.setattr(trie, name, value)
    rows = small_rows()
    got = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), reseed).collect()
    assert sorted((tuple(r)[:8] for r in got), key=lambda r: r[:2]) == plain_trie(rows, reseed)
    tour = sorted([r["enter_at"] for r in got] + [r["exit_at"] for r in got])
    assert tour == list(range(2 * len(got)))
    inside = {(r["conv_id"], r["depth"]): (r["enter_at"], r["exit_at"]) for r in got}
    for r in got:
        if r["depth"]:
            up = inside[r["parent_conv_id"], r["depth"] - 1]
            assert up[0] < r["enter_at"] < r["exit_at"] < up[1]


def test_empty_nulls_and_clashing_columns(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "u", "a")], SCHEMA)).collect() == []
    rows = [(5, None, None, None, 1, "z"), (5, None, None, None, 2, "z"), (25, 0, "u", "a" * 100_000, 3, "z")]
    got = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA + ", depth long, piece string")).collect()
    assert sorted(tuple(r)[:8] for r in got) == plain_trie(rows)
