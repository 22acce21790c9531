"""Personal data: base spans against plain patterns, added spans against planted ones."""

from __future__ import annotations

import hashlib
import random
import re

from tidemark.llm import pii

SCHEMA = "doc_id long, text string"
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(d) * 2, 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    out = []
    for nth, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), nth, kind, m.end()))
    return sorted(out)


def expected(text):
    spans = plain_spans(text)
    told = ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)
    return (*(sum(x[2] == k for x in spans) for k in PATTERNS), hashlib.sha256(told.encode()).hexdigest(), told)


def card(rng, good=True):
    body = "".join(rng.choice("0123456789") for _ in range(15))
    return next(body + d for d in "0123456789" if luhn(body + d) == good)


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = "the an éon 🙂 lyat thon, und der. oneß at on".split()
    out = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(3, 40))]
        for _ in range(rng.randint(0, 4)):
            text.insert(rng.randint(0, len(text)), rng.choice([
                f"x{rng.randint(0, 99)}.y@mail{rng.randint(0, 9)}.example.com", ".".join(str(rng.randint(0, 300)) for _ in range(4)), card(rng, rng.random() < 0.5),
                f"+{rng.randint(1, 99)} ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}", f"{rng.randint(1, 30)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}", f"20{rng.randint(10, 30)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", str(rng.randint(0, 10 ** 9))]))
        out.append((i, " ".join(text)))
    return out


HARD = ["", None, "a@b.c_d@e.f", "a@b..c x@y.z.", "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3", "001.002.003.004", "4111 1111-1111 1111 4111111111111111", "+1 (415) 555-0123. +1", "++1 2 3 4 5 6 7 8 9 0 1",
        "12 345 6789 0123 4567 8901 2345", "é😀 a@b.c 😀 1.2.3.4", "@@@", "+4111111111111111@b.co", "٣.٣.٣.٣ 1.2.3.4"]


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(2)
    rows = list(enumerate(HARD)) + [(None, "a@b.c"), (0, "")]
    rows += [(100 + k, "".join(rng.choice("0123456789.+-() @ab\n") for _ in range(200))) for k in range(200)]
    got = pii.find(spark.createDataFrame([(i, t, 1, 2) for i, t in rows], SCHEMA + ", row int, start int")).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(expected(t)[:5])
    for r in got:
        assert tuple(r)[1:6] in want[r["doc_id"]]
        base = {s for i, t in rows if i == r["doc_id"] for s in expected(t)[5].split(",") if s}
        assert len(r["spans"].split(",") if r["spans"] else []) == sum(tuple(r)[1:5]) + r["n_added"] and (not base or r["doc_id"] == 0 or base <= set(r["spans"].split(",")))


def test_other_spellings_are_added_and_numbers_left_alone(spark):
    rng = random.Random(9)
    good = card(rng)
    planted = {1001: ("call (415) 555-0123 now", "phone:5:19"), 1002: ("tel 415-555-0123", "phone:4:16"), 1003: ("jane.doe [at] mail [dot] example [dot] com", "email:0:42"),
               1004: (f"card {'.'.join(re.findall('....', good))} ok", "card:5:24"), 1005: ("see 10.20[.]30[.]40 there", "ip:4:19")}
    clean = {2001: "released 2024-01-15 as 3.1.4", 2002: f"number {card(rng, False)} is none", 2003: "we met at noon. Then left at two", 2004: "pages 120-134 of 2019"}
    rows = corpus(400) + [(k, t) for k, (t, _) in planted.items()] + list(clean.items())
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: got[k]["spans"] for k in planted} == {k: s for k, (_, s) in planted.items()}
    assert {k: got[k]["spans"] for k in clean} == dict.fromkeys(clean, "")
    for i, t in rows[:400]:
        assert tuple(got[i])[1:6] == expected(t)[:5]


def test_long_runs_empty_table_and_no_positives(spark):
    long = [(1, "a" * 300_000), (2, "1" * 300_000), (3, "1.2.3.4 " * 20_000), (4, "a." * 100_000 + "@" + "b." * 100_000), (5, "+" * 100_000), (6, "1 " * 100_000)]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(long, SCHEMA)).collect()}
    none = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest())
    for i, t in long:
        assert tuple(got[i])[1:6] == (none if i in (1, 2) else expected(t)[:5])  # plain patterns read a run again from each place
    assert pii.find(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [r["spans"] for r in pii.find(spark.createDataFrame([(1, "555-0123 x"), (2, None)], SCHEMA)).collect()] == ["", ""]


def test_native_plan(spark, monkeypatch):
    seen = []
    keep = pii.stored
    monkeypatch.setattr(pii, "stored", lambda df, label: (seen.append(df._jdf.queryExecution().toString()), keep(df, label))[1])
    out = pii.find(spark.createDataFrame(corpus(50), SCHEMA).where("doc_id >= 0"))
    plan = "".join(seen) + out._jdf.queryExecution().toString()
    assert not re.search(r"Python|Arrow|Pandas|MapPartitions", plan)
