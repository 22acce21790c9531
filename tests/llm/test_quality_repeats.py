"""Texts that repeat themselves are rejected, however long."""

from tidemark.llm import quality


def test_looping_texts_are_rejected_at_any_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = [r.text for r in docs.join(labels.where("quality = 1"), "doc_id").where("length(text) between 2000 and 20000").orderBy("doc_id").limit(3).collect()]
    sentence = good[0].split(".")[0] + ". "
    n = len(sentence.split())
    rows = [(10_000_000 + i, sentence * (words // n)) for i, words in enumerate((200, 1500, 2100, 30_000, 200_000))]
    rows += [(10_000_010 + i, (t + "\n") * 20) for i, t in enumerate(good)]
    got = {r.doc_id: r.kept for r in quality.classify(docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))).where("doc_id >= 10000000").collect()}
    assert len(got) == len(rows) and not any(got.values()), got


def test_looping_texts_without_blanks_are_rejected_and_plain_ones_are_not_bad():
    import numpy as np
    r = np.random.default_rng(5)
    signs = [chr(c) for c in range(0x4E00, 0x4E00 + 1500)]
    chinese = "".join("".join(r.choice(signs, 18)) + "，。"[k % 2] for k in range(60))
    thai = "".join(r.choice([chr(c) for c in range(0x0E01, 0x0E2F)] + ["ิ", "่"], 900))
    said = {n: dict(zip((x[0] for x in quality.LABELLERS), quality.votes(quality.measures(t, quality.Shapes())[0])))
            for n, t in (("chinese", chinese), ("thai", thai), ("loop", chinese[:40] * 3000), ("one word", "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 600_000))))}
    assert "b" not in said["chinese"].values() and "b" not in said["thai"].values()
    assert said["loop"]["loops"] == "b" and said["loop"]["poor_words"] == "b"
    assert said["one word"]["unbroken"] == "b"


def test_posteriors_equal_plain_expectation_maximisation():
    import math
    patterns = {"gg-ggggggg": 400, "gggg-ggggg": 300, "bgggbggggg": 60, "bbggbg-bgg": 30, "ggggggggbg": 7, "----------": 5}
    post = {p: 0.1 if "b" in p else 0.9 for p in patterns}
    for _ in range(quality.EM_ROUNDS):
        good, bad = sum(post[p] * n for p, n in patterns.items()), sum((1 - post[p]) * n for p, n in patterns.items())
        new = {p: math.log((good + 1) / (bad + 1)) for p in patterns}
        for k in range(len(quality.LABELLERS)):
            for sign, prior in ((1, 0.02), (-1, 0.5)):
                seen = {p: n * (post[p] if sign > 0 else 1 - post[p]) for p, n in patterns.items()}
                q = (sum(w for p, w in seen.items() if p[k] == "b") + prior) / (sum(w for p, w in seen.items() if p[k] != "-") + 1)
                for p in patterns:
                    new[p] += sign * {"b": math.log(q), "g": math.log(1 - q), "-": 0}[p[k]]
        post = {p: 1 / (1 + math.exp(-max(-30, min(30, v)))) for p, v in new.items()}
    got = quality.estimate(patterns)
    assert all(abs(got[p] - post[p]) < 1e-9 for p in patterns)
