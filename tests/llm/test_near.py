"""Proximity matches of benchmark windows against brute force, whatever documents share a row of the index."""

import pytest

from tests.llm import brute
from tests.llm.test_operators import prose
from tidemark.llm import decontaminate, plans


def near_items(text, items, near, size=10):
    w, out = brute.ALNUM.findall(brute.low(text)), set()
    exact = set()
    for item, passage in items:
        b = brute.ALNUM.findall(brute.low(passage))
        for i in range(max(1, len(b) - size + 1)):
            g = b[i:i + size]
            k = len(g)
            if any(w[s:s + k] == g for s in range(len(w) - k + 1)):
                exact.add(str(item))
            if k > 2 and any(5 * sum(g[j] in w[max(0, s + j - near):max(0, s + j + near + 1)] for j in range(k)) >= 4 * k for s in range(-k - near, len(w) + near)):
                out.add(str(item))
    return sorted(out - exact)


@pytest.mark.parametrize("parts", [1, 4])
def test_near_equals_brute_force(spark, parts):
    items = [(1, prose(14, 70)), (2, prose(10, 71)), (3, "rare " + prose(11, 72))]
    texts = [items[0][1], prose(20, 5) + " " + items[1][1] + " " + prose(5, 6), items[2][1]]
    for _, t in items:
        w = t.split()
        for k in range(len(w)):
            texts += [" ".join(w[:k] + ["other"] + w[k + 1:]), " ".join(w[:k] + ["put", "in"] + w[k:]), " ".join(w[:k] + w[k + 1:]), prose(7, k) + " " + " ".join(w[:k] + ["x", "y"] + w[k + 2:])]
        texts += [" ".join(w[::-1]), " ".join(w[:6]), " ".join(w[5:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).repartition(parts)
    got = {r.doc_id: r.near_items for r in decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), near=2).collect()}
    assert got == {i: near_items(t, items, 2) for i, t in enumerate(texts)}
    assert sum(map(bool, got.values())) > 60


def test_a_registered_query_makes_near_matches(spark):
    import __spark_entry__ as entry
    rows = entry.queries()["near_decontaminate"](spark, "/root/testdata/sf0.001").collect()
    exact = {r.doc_id: r.contaminated for r in plans.op6_decontaminate(spark, "/root/testdata/sf0.001").collect()}
    assert {r.doc_id: r.contaminated for r in rows} == exact and all(r.near == (r.n_near_items > 0) for r in rows)
