"""Both ends of a link count it, also where only one asks the other's list."""

import numpy as np
import pytest

from tidemark.llm import vectors


@pytest.mark.parametrize("probes", [2, 12])
def test_links_found_from_one_end_count_at_both(spark, monkeypatch, probes):
    monkeypatch.setattr(vectors, "PROBES", probes)
    r = np.random.default_rng(11)
    base = r.normal(size=(1000, 16))
    base /= np.linalg.norm(base, axis=1)[:, None]
    aside = r.normal(size=base.shape)
    aside -= (aside * base).sum(axis=1)[:, None] * base
    aside /= np.linalg.norm(aside, axis=1)[:, None]
    x = np.concatenate([base, 0.955 * base + np.sqrt(1 - 0.955 ** 2) * aside])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    true = unit @ unit.T >= 0.95
    np.fill_diagonal(true, False)
    rows = vectors.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    got = {q.vec_id: q.n_links for q in rows}
    size = {}
    for q in rows:
        size[q.component_id] = size.get(q.component_id, 0) + 1
    pairs = [(q.vec_id, q.component_id) for q in rows if size[q.component_id] == 2 and q.vec_id != q.component_id]
    assert len(pairs) > 500 and all(got[a] == got[b] == 1 for a, b in pairs)
    assert all(got[i] <= true[i].sum() for i in got)
    if probes == 12:
        assert sum(got.values()) >= 0.98 * true.sum()
