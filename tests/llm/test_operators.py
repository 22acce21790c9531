"""Each operator against a plain version, and on nulls, empty, long, repeated and tied rows, empty tables and odd columns."""

import hashlib
import random
import re

import numpy as np
import pytest

from tests.llm import brute
from tidemark.llm import bpe, decontaminate, htmltext, language, licenses, neardup, quality, quotes, urlfilter, vectors

P = pytest.importorskip("public_tokenizers")
RNG = random.Random(5)
VOCAB = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


ODD_TEXTS = [None, "", "   \n\t ", "one", "a b c d", "x" * 3000, "é" * 50, "same text here again and again once more", "same text here again and again once more", prose(30000, 1), "日本語 テキスト \x1c\x1f ½ ²", "1 2 3 !!! ???"]


def frame(spark, texts, extra=True):
    rows = [(i if i != 4 else None, t, "k", 1, "i") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, n_words int, ids string")
    return df if extra else df.select("doc_id", "text")


@pytest.fixture(scope="module")
def copies(spark):
    """Texts with exact copies, near copies around the limit, chains, and a large group of near copies."""
    texts = {i: prose(60, i) for i in range(40)}
    n = 100
    for i in range(0, 20, 2):
        for cut in (1, 2, 3, 5, 8):
            w = texts[i].split()
            for k in range(cut):
                w[(k * 11 + cut) % len(w)] = f"new{i}{k}"
            texts[n] = " ".join(w)
            n += 1
    base = prose(80, 999).split()
    for i in range(60):
        w = base[:]
        w[i % 80] = f"v{i}"
        texts[n] = " ".join(w)
        n += 1
    for i in range(5):
        texts[n] = texts[1]
        n += 1
    texts[n] = texts[3].upper()
    return texts, spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)


def test_bpe_equals_the_library(spark):
    import tiktoken
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ODD_TEXTS + ["  a\x1cb  c　d\x85 e\n\n x  ", "a" * 3000 + " " + "ab" * 700, "it's I'LL we'll 日本語 １２３ ा कि 😀😀", "\r\n\r\n  z"]
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(frame(spark, texts), ranks, P.PATTERN, digest=True).collect()}
    want = set()
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        want.add((i if i != 4 else None, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    rows = bpe.encode(frame(spark, texts), ranks, P.PATTERN).collect()
    assert len(rows) == len(texts) and all(bytes(r.decoded).decode() == (texts[r.doc_id if r.doc_id is not None else 4] or "") for r in rows)
    assert bpe.encode(frame(spark, texts).limit(0), ranks, P.PATTERN).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_bpe_merges_long_words_like_short_ones(seed):
    r = random.Random(seed)
    ranks = {bytes([b]): b for b in range(256)}
    for _ in range(60):
        ranks.setdefault(bytes(r.choice(b"ab") for _ in range(r.randint(2, 5))), 256 + len(ranks))
    word = bytes(r.choice(b"ab") for _ in range(150))
    assert bpe.merge(word, ranks) == bpe._merge_long(word, ranks)


def test_decontamination_equals_brute_force(spark):
    items = [(1, prose(30, 7)), (2, prose(12, 8)), (10, "Short item!"), (3, None), (4, ""), (5, prose(30, 7)), (None, prose(20, 9)), (6, "z z z z z z z z z z z z")]
    texts = ODD_TEXTS + [prose(50, 50) + " " + prose(30, 7) + " tail", "... " + prose(12, 8).upper() + prose(5, 2), "a short, item b", "z " * 30, prose(9, 8), " ".join(prose(30, 7).split()[3:17])] * 2
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(frame(spark, texts), bench, near=2).collect()
    want = brute.hits(texts, [x for x in items if x[0] is not None])
    assert sorted((r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted((*w, w[1] > 0) for w in want)
    assert {r.doc_id for r in got} == {i if i != 4 else None for i in range(len(texts))}
    assert decontaminate.decontaminate(frame(spark, texts), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(frame(spark, texts).limit(0), bench).count() == 0


def test_decontamination_finds_near_phrases(spark):
    words = prose(10, 70).split()
    docs = spark.createDataFrame([(1, "a b " + " ".join(words[:4] + ["inserted"] + words[4:])), (2, " ".join(words[::-1])), (3, " ".join(words))], "doc_id long, text string")
    got = {r.doc_id: (r.items, r.near_items) for r in decontaminate.decontaminate(docs, spark.createDataFrame([(9, " ".join(words))], "item_id long, text string"), near=1).collect()}
    assert got == {1: ([], ["9"]), 2: ([], []), 3: (["9"], [])}


def test_benchmark_in_blocks_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 5)
    items = [(i, prose(25, i)) for i in range(6)]
    texts = [prose(20, 90) + " " + prose(25, i) + " " + prose(25, i + 1) for i in range(6)]
    got = decontaminate.decontaminate(frame(spark, texts, False), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got) == sorted(brute.hits(texts, items))


def test_near_duplicates_equal_brute_force(spark, copies):
    texts, df = copies
    want = brute.near(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    assert got == {k: (len(brute.shingles(texts[k])), c, c == k) for k, c in want.items()}


def test_near_duplicates_in_small_blocks(spark, copies, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    texts, df = copies
    want = brute.near(texts)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == want


def test_near_duplicates_of_odd_rows(spark):
    rows = neardup.near_duplicates(frame(spark, ODD_TEXTS)).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(ODD_TEXTS) and by[0].n_shingles == by[1].n_shingles == by[2].n_shingles == 0 and by[3].n_shingles == 1
    assert by[8].component_id == 7 and not by[8].kept and by[None].component_id is None and by[None].kept
    assert neardup.near_duplicates(frame(spark, ODD_TEXTS).limit(0)).count() == 0
    twice = frame(spark, ["w x y z q r"] * 2).withColumn("doc_id", __import__("pyspark").sql.functions.lit(3))
    assert [r.component_id for r in neardup.near_duplicates(twice).collect()] == [3, 3]


def test_sketch_estimates_similarity():
    r = np.random.default_rng(3)
    for share in (0.8, 0.9, 1.0):
        a = np.unique(r.integers(0, 2 ** 63, 2000).astype(np.uint64))
        b = np.unique(np.concatenate([a[:int(len(a) * share)], r.integers(0, 2 ** 63, len(a) - int(len(a) * share)).astype(np.uint64)]))
        s = neardup.odd_sketch(neardup.minhash([a, b]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        differ = int(np.bitwise_count(s[0] ^ s[1]).sum())
        assert abs(neardup.estimated_similarity(differ) - true) < 0.15
        if true >= 0.75:
            assert differ <= neardup.sketch_bound()
        w = [neardup.whole_sketch(x).view(np.uint64) for x in (a, b)]
        assert np.bitwise_count(w[0] ^ w[1]).sum() <= len(np.setxor1d(a, b))


def test_language_is_right_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98 and all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    docs = frame(spark, ODD_TEXTS).selectExpr("*", "case when doc_id % 3 = 0 then 'aa' when doc_id % 3 = 1 then 'bb' end as lang", "1 as score", "1 as got")
    rows = {r.doc_id: r for r in language.identify(docs).collect()}
    assert len(rows) == len(ODD_TEXTS) and [rows[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and rows[0].score == 0 and rows[3].lang_pred in ("aa", "bb")
    assert all(r.lang_pred == "und" for r in language.identify(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect())
    assert language.identify(docs.limit(0)).count() == 0


def test_language_counts_long_texts_whole(monkeypatch):
    text = prose(500, 4)
    whole = language.grams(text)
    monkeypatch.setattr(language, "PIECE", 97)
    assert (language.grams(text) == whole).all()


def test_quality_agrees_with_labels_it_never_saw(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality.classify(docs).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    assert np.mean([r.kept == bool(r.quality) for r in rows]) > 0.97
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.99


def test_quality_of_odd_rows(spark):
    rows = {r.doc_id: r for r in quality.classify(frame(spark, ODD_TEXTS).selectExpr("*", "1 as score", "1 as votes")).collect()}
    assert len(rows) == len(ODD_TEXTS) and not any(rows[i].kept for i in (0, 1, 2)) and rows[7].score == rows[8].score
    assert quality.classify(frame(spark, ODD_TEXTS).limit(0)).count() == 0


def test_expectation_maximisation_finds_the_labellers_accuracies():
    r = np.random.default_rng(1)
    good = r.random(20000) < 0.8
    says = np.where(r.random((20000, len(quality.LABELLERS))) < np.linspace(0.75, 0.95, len(quality.LABELLERS)), good[:, None], ~good[:, None])
    votes = ["".join("g" if x else "b" for x in row) for row in says]
    post = quality.estimate(__import__("collections").Counter(votes))
    assert np.mean([(post[v] >= 0.5) == g for v, g in zip(votes, good)]) > 0.95


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 32)
    r = np.random.default_rng(2)
    base = r.normal(size=(40, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for i in range(200):
        rows.append((1000 + i, (base[i % 7] + r.normal(size=16) * r.choice([0.05, 0.2, 0.3])).tolist()))
    rows += [(2000, rows[0][1]), (2001, [2 * x for x in rows[0][1]]), (2002, rows[0][1]), (3000, None), (3001, []), (3002, [0.0] * 16), (3003, [float("nan")] * 16), (3004, [None] + [1.0] * 15), (3005, [1.0, 2.0]), (3006, [1.0, 2.0]), (3007, [float("inf")] * 16), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as n", "'x' as node", "2 as copies")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    like = lambda a, b: a in unit and b in unit and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95
    ids = [i for i, _ in rows if i is not None]
    comp = brute.joined(ids, like)
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in vectors.near_duplicates(df).collect()}
    assert got.pop(None) == (0, None, True)
    assert got == {i: (sum(like(i, j) for j in ids if j != i), comp[i], comp[i] == i) for i in ids}
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_vector_recall_on_the_given_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = e.orderBy("vec_id").collect()
    m = np.array([r.embedding for r in rows], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    deg = (m @ m.T >= 0.95).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(e).collect()}
    assert sum(got.values()) >= 0.9 * deg.sum() and all(got[r.vec_id] <= d for r, d in zip(rows, deg))


def glob_pattern(glob):
    return re.compile("".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in re.findall(r"\*\*|.", glob, re.S)), re.S)


def test_automaton_equals_regular_expressions():
    r = random.Random(1)
    globs = ["".join(r.choice("ab/?*.") for _ in range(r.randint(1, 90 if k % 5 == 0 else 8))) for k in range(60)] + ["", "**", "*"]
    texts = ["".join(r.choice("ab/.") for _ in range(r.randint(0, 12))) for _ in range(300)]
    got = urlfilter.Automaton(globs).match([t.encode() for t in texts])
    assert all(bool(glob_pattern(g).fullmatch(t)) == got[i, j] for i, t in enumerate(texts) for j, g in enumerate(globs))


def test_url_verdicts(spark):
    urls = [None, "", "no scheme", "HTTP://Example.ORG/es/1", "http://sub.example.org/en/12?x=/de/", "http://example.org", "http://notexample.org/es/", "https://a.com/de/x#y", "https://a.com/DE/x", "x://a.net/b.org/", "x://h.com?/fr/", "x://ü.org/é", "https://ads.net/x", "https://a.net/" + "p" * 5000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' as host", "'y' as rule")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(df).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("example.org", "/es/1", "example.org/es/", "block") and got[4] == ("sub.example.org", "/en/12", "example.org/en/1", "block")
    assert got[5] == ("example.org", "", None, "allow") and got[6] == ("notexample.org", "/es/", "org/", "allow") and got[7][2:] == ("com/de/", "block")
    assert got[8][2:] == (None, "allow") and got[9] == ("a.net", "/b.org/", None, "allow") and got[10][1:3] == ("", None) and got[11] == ("ü.org", "/é", "org/", "allow") and got[12][3] == "block"
    assert urlfilter.filter_urls(df.limit(0)).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header class="top"><a href="/">Site</a> slogan here.</header><nav><ul><li><a>Home</a><li><a>News</a></ul></nav>
<div class="cookie-notice">We use cookies. Accept?</div><article><h1>Head &amp; line</h1><p>First <b>bo</b>ld&nbsp;text.<br>Next   line.<p>Second, a longer one &#233;.<div class="ad">Buy now, cheap.</div><p>End.</article>
<aside>Side bar text, also long enough to be mistaken for content.</aside><section id="comments"><article class="comment"><p>I think so too, really.</p></article></section><form>Name <input></form><script>var t="</p>";</script><footer>&copy; us</footer></body></html>"""


def test_page_text(spark):
    pages = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain text only, without any markup."), (5, "u", "<p>cut off <b>here &am"), (6, "u", "<div class='ad'>only advert</div>"), (7, "u", "<article>" + "<p>long one, yes.</p>" * 2000), (1, "u", PAGE)]
    got = htmltext.extract(spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as text", "1 as n_chars")).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(pages) and by[1] == "Head & line First bold text. Next line. Second, a longer one é. End."
    assert by[2] == by[3] == by[6] == "" and by[4] == pages[3][2] and by[5].startswith("cut off here") and by[7] == " ".join(["long one, yes."] * 2000) and all(r.n_chars == len(r.text) for r in got)
    assert htmltext.extract(spark.createDataFrame(pages, "page_id long, url string, html string").limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_cut_is_minimal(seed):
    r = random.Random(seed)
    n = 7
    content, other = ([r.choice([0, 1, 2, 5]) for _ in range(n)] for _ in "ab")
    ties = [(i, j, r.choice([0.5, 1, 3])) for i in range(n) for j in range(i) if r.random() < 0.4]
    price = lambda keep: sum(o if k else c for c, o, k in zip(content, other, keep)) + sum(w for i, j, w in ties if keep[i] != keep[j])
    best = min(price([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
    assert abs(price(htmltext.minimum_cut(content, other, ties)) - best) < 1e-6


def test_alignment():
    assert licenses.align(list("abcxdef"), list("abcydef")) == [(0, 0), (1, 1), (2, 2), (4, 4), (5, 5), (6, 6)]
    assert licenses.rising([(0, 3), (1, 1), (2, 2), (3, 0), (4, 4)]) == [(1, 1), (2, 2), (4, 4)]
    r = random.Random(4)
    for _ in range(200):
        a, b = ([r.choice("abcdef") for _ in range(r.randint(0, 12))] for _ in "ab")
        got = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p < q and u < v for (p, u), (q, v) in zip(got, got[1:]))


def test_license_scan(spark):
    mit, by = licenses.TEMPLATES["MIT"][1], "Licensed under CC BY-NC 4.0."
    texts = ODD_TEXTS + [f"{prose(30, 1)}\n{by}\n{by}\n{prose(9, 2)}", mit.replace("granted", "given").replace("copy,", "copying,"), "released under the license of a king", prose(200, 3) + " RELEASED under the\n MIT license " + prose(300, 4)]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, texts)).collect()}
    n = len(ODD_TEXTS)
    assert len(got) == len(texts) and all(got[i].n_spans == 0 for i in range(n) if i != 4)
    assert got[n].licenses == ["CC-BY-NC-4.0"] and [(s.start, s.end) for s in got[n].spans] == [(30, 37), (37, 44)]
    assert got[n + 1].licenses == ["MIT"] and 0.9 < got[n + 1].coverage < 1 and got[n + 2].n_spans == 0 and (got[n + 3].spans[0].start, got[n + 3].spans[0].end) == (200, 205)
    assert licenses.scan(frame(spark, texts).limit(0)).count() == 0


def test_quotes(spark):
    a, b = "Hello there.\nHow are you?", "Fine, thanks."
    rows = [(1, 0, "u", a), (1, 1, "v", "On Monday u wrote:\n> Hello there.\n>  HOW are you?\n\n" + b), (1, 2, "u", "> > hello there.\n> > how are you?\n>\n> " + b + "\nGood."), (1, 3, "w", "> How are you?\nLate answer."),
            (1, 4, "w", "> never said\nOdd."), (2, 0, "u", "> Fine, thanks.\nOther talk."), (1, 5, None, None), (None, 0, "u", "x"), (1, None, "u", "> Hello there.\ny"), (1, 0, "u", a)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as msg", "2 as level", "3 as hash")
    got = {(r.conv_id, r.turn): r for r in quotes.link(df).collect()}
    assert len(got) == 9 and got[1, 1].text == b and got[1, 1].parent_turn == 0 and got[1, 2].text == "Good." and got[1, 2].parent_turn == 1 and got[1, 2].origins == [0, 1]
    assert got[1, 3].parent_turn == 0 and got[1, 3].thread_level == 1 and got[1, 2].thread_level == 2 and got[1, 2].thread_turn == 0
    assert got[1, 4].parent_turn is None and got[1, 4].n_quotes == 1 and got[1, 4].n_linked == 0 and got[1, 4].thread_turn == 4 and got[2, 0].parent_turn is None and got[1, 5].text == "" and got[None, 0].text == "x"
    assert quotes.link(df.limit(0)).count() == 0


def test_quotes_of_given_conversations(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    own = {(r.conv_id, r.turn): " ".join((r.text or "").split()) for r in turns.collect()}
    got = quotes.link(quotes.quoted_replies(turns)).collect()
    assert {(r.conv_id, r.turn): " ".join(r.text.split()) for r in got} == own
    assert all(r.parent_turn == r.turn - 1 and r.n_linked == r.n_quotes for r in got if (r.conv_id, r.turn - 1) in own and own[r.conv_id, r.turn - 1])
