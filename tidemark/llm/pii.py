r"""Operator 13: personal data by boosted trees over candidate spans, with DataFrame functions only.

Base spans are the matches of four fixed patterns. High-recall generators then propose further spans: runs of digits with
any separators, with and without blanks, each as a phone, a card and an address, and mail addresses with written-out signs;
proposals overlap. Trees of depth two, boosted on the logistic loss, score each proposal by its format (digits, groups,
separators, checksum, value ranges) and context (cue words before it, the characters around it); the signs that define a
base pattern (a plus, an at sign, the kind of dot) are no features. Proposals equal to a base span are the positives, and
so are other spellings of the same data, other proposals the negatives. All proposals count: Spark sums them by feature
pattern, and the trees are fitted on these sums, of which there are ``PATTERNS`` at most (rarer ones are left out of the fit
alone). One fold of the texts is held out; there scores become probabilities by isotonic regression, and a kind's threshold
is where they reach ``LEAST``. Proposals over it are added, unless they meet a base span or a proposal of higher
probability.

Patterns are written so that a run of characters is read once: a match starts at the end of the last one or after a
character that cannot belong to it, and repeats are possessive. Positions are sums of the lengths between matches, windows
over one text's matches; documents without a sign of personal data leave after the first scan.

Defined results: null text is empty; a text without spans has an empty list; rows that repeat each get their result; null
``doc_id`` is kept; positions count code points; an empty table gives no rows, a table without positives adds no spans;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
#: Feature patterns fitted on at most, rounds, step, and least probability of an added span.
PATTERNS, ROUNDS, STEP, LEAST = 1 << 16, 40, 0.3, 0.9
#: Texts whose key falls into this one of five folds calibrate the scores.
HELD = 0
#: Characters of context before a proposal.
CONTEXT = 24

_MAIL = r"[A-Za-z0-9._%+-]"
#: What a pattern may not follow, unless the last match ends there, and the pattern.
BASE = {
    "email": (_MAIL, _MAIL + r"++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]", r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (None, r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (None, r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_AT = r"(?:@|\x20@\x20|＠|\x20?(?:\[at\]|\(at\)|\{at\})\x20?)"
_DOT = r"(?:\.|．|\x20?(?:\[dot\]|\(dot\)|\{dot\}|\[\.\])\x20?)"
PROPOSED = {
    "mail": (_MAIL, r"(?i:" + _MAIL + r"++(?:" + _AT + r"[A-Za-z0-9-]++(?:" + _DOT + r"[A-Za-z0-9-]++)++|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++))"),
    "wide": (r"[0-9]", r"(?:\+?\([0-9]|\+?[0-9])(?:[\x20().\[\]/-]{0,3}+[0-9])++"),
    "narrow": (r"[0-9]", r"\+?[0-9](?:[().\[\]/-]{0,3}+[0-9])++"),
}
_CUES = {"phone": r"tel|phone|call|fax|mobil|cell|whatsapp|sms", "card": r"card|visa|master|amex|credit|debit|karte|tarjeta|carte",
         "ip": r"\bip\b|host|server|addr|ping", "email": r"mail|write to|contact"}
_NUMBERED = r"version|isbn|order|invoice|\bid\b|\bno\b|page|section|serial|\bv$"
FEATURES = ("kind", "digits", "groups", "sep", "first", "last", "valid", "cue", "left", "right")


def _matches(text: Column, rule: tuple[str | None, str], group: int) -> Column:
    """Group 1 is what lies between matches, 2 the match, 3 the character after it; 0 is 1 and 2."""
    after, pattern = rule
    gap = r"|(?s:.*?)" + after.replace("[", "[^", 1) if after else r"(?s:.*?)"
    return F.regexp_extract_all(text, F.lit(rf"\G({gap})({pattern})(?=((?s:.?)))"), F.lit(group))


def _found(text: Column, source: str, rule, may: Column, context: bool) -> Column:
    """Matches of one pattern as ``source, k, upto, hit, left, right``; ``upto`` is the length up to the match's end."""
    none = F.array().cast("array<string>")
    of = lambda group: F.when(may, _matches(text, rule, group)).otherwise(none)
    left = F.transform(of(1), lambda x: F.lower(F.right(x, F.lit(CONTEXT)))) if context else none
    right = of(3) if context else none
    told = F.zip_with(F.transform(of(0), lambda x: F.length(x)), of(2), lambda u, h: F.struct(u.alias("upto"), h.alias("hit")))
    told = F.zip_with(told, F.zip_with(left, right, lambda x, y: F.struct(x.alias("left"), y.alias("right"))), lambda x, y: F.struct(x["upto"].alias("upto"), x["hit"].alias("hit"), y["left"].alias("left"), y["right"].alias("right")))
    return F.transform(told, lambda x, k: F.struct(F.lit(source).alias("source"), k.alias("k"), x["upto"].alias("upto"), x["hit"].alias("hit"), x["left"].alias("left"), x["right"].alias("right")))


def _spans(docs: DataFrame) -> DataFrame:
    """One row per document: ``row, doc_id, fold, found``. Patterns run only where their signs are there."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    may = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), "phone": text.contains("+"),
           "mail": text.rlike(r"(?i)@|＠|[\[({]at[\])}]|\x20at\x20"), "wide": text.rlike(r"[0-9](?:[\x20().\[\]/-]{0,3}[0-9]){3}")}
    may["narrow"] = may["wide"]
    parts = [_found(text, s, r, may[s], False) for s, r in BASE.items()] + [_found(text, s, r, may[s], True) for s, r in PROPOSED.items()]
    return stored(docs.select("doc_id", F.pmod(F.xxhash64(text), F.lit(5)).alias("fold"), F.concat(*parts).alias("found")).withColumn("row", F.monotonically_increasing_id()), "spans")


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, r"[^0-9]", "")


def _proper(kind: Column, hit: Column) -> Column:
    """The rules that a base match must pass."""
    digits = _digits(hit)
    n = F.length(digits)
    return (F.when(kind == "ip", hit.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"))
            .when(kind == "card", n.between(14, 19) & F.call_function("luhn_check", F.when(n.between(14, 19), digits).otherwise(F.lit("0"))))
            .when(kind == "phone", n.between(10, 15)).otherwise(F.lit(True)))


def _placed(spans: DataFrame) -> DataFrame:
    """Matches with their positions: ``row, fold, source, start, end, hit, left, right``."""
    each = spans.where(F.size("found") > 0).select("row", "fold", F.explode("found").alias("m")).select("row", "fold", "m.*")
    so_far = Window.partitionBy("row", "source").orderBy("k")
    return (each.withColumn("end", F.sum(F.col("upto").cast("long")).over(so_far)).withColumn("start", F.col("end") - F.length("hit"))
            .select("row", "fold", "source", "start", "end", "hit", "left", "right"))


def _side(c: Column) -> Column:
    """Class of a neighbouring character."""
    return (F.when((c == "") | c.rlike(r"^\s"), 0).when(c.rlike(r"^\p{L}"), 1).when(c.rlike(r"^[0-9.]"), 2).when(c.rlike("^[\"'=:]"), 3).when(c.rlike(r"^[-/+$€£#_]"), 4).otherwise(5)).cast("int")


def _features(rows: DataFrame) -> DataFrame:
    """Small numbers for ``kind, hit, left, right``; nothing here tells a plus, an at sign or the kind of dot."""
    hit, mail = F.col("hit"), F.col("kind") == "email"
    plain = F.regexp_replace(F.regexp_replace(hit, r"^\+", ""), r"\[(\.)\]", r"$1")
    digits = _digits(hit)
    groups = F.split(F.regexp_replace(plain, r"^[^0-9]+|[^0-9]+$", ""), r"[^0-9]+")
    labels = F.split(F.regexp_replace(F.lower(hit), r"．|\x20?(?:\[dot\]|\(dot\)|\{dot\}|\[\.\])\x20?|\x20dot\x20", "."), r"\.")
    last = F.element_at(labels, -1)
    marks = F.regexp_replace(plain, r"[0-9]", "")
    sep = (F.when(marks == "", 0).when(marks.rlike(r"[()]"), 4).when(marks.rlike(r"^\x20+$"), 1).when(marks.rlike(r"^-+$"), 2).when(marks.rlike(r"^\.+$"), 3).otherwise(5))
    date = plain.rlike(r"^(?:(?:19|20)[0-9]{2}[-/. ][01]?[0-9][-/. ][0-3]?[0-9]|[0-3]?[0-9][-/. ][01]?[0-9][-/. ](?:19|20)?[0-9]{2})$")
    valid = (F.when(mail, last.rlike(r"^[a-z]{2,6}$").cast("int")).when(date, 2).when(F.col("kind") == "ip", _proper(F.lit("ip"), plain).cast("int"))
             .when(F.col("kind") == "card", F.call_function("luhn_check", F.when(F.length(digits).between(1, 32), digits).otherwise(F.lit("1"))).cast("int")).otherwise(0))
    own = F.lit(False)
    for kind, words in _CUES.items():
        own = own | ((F.col("kind") == kind) & F.col("left").rlike(words))
    # words that speak for the kind stand above none, those for something else below
    cue = F.when(own, 3).when(F.col("left").rlike(_NUMBERED), 0).when(F.col("left").rlike("|".join(_CUES.values())), 1).otherwise(2)
    number = {
        "kind": F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), "digits": F.when(mail, 0).otherwise(F.least(F.length(digits), F.lit(20))),
        "groups": F.least(F.when(mail, F.size(labels)).otherwise(F.size(groups)), F.lit(6)), "sep": F.when(mail, 0).otherwise(sep),
        "first": F.when(mail, 0).otherwise(F.least(F.length(groups[0]), F.lit(6))), "last": F.least(F.when(mail, F.length(last)).otherwise(F.length(F.element_at(groups, -1))), F.lit(6)),
        "valid": valid, "cue": cue, "left": _side(F.right("left", F.lit(1))), "right": _side(F.col("right"))}
    return rows.select("*", *[F.coalesce(number[f].cast("int"), F.lit(0)).alias(f"f_{f}") for f in FEATURES])


def _spellings(kind: Column, hit: Column) -> Column:
    """Other ways to write a base span: without country code, with other separators."""
    local = F.right(_digits(hit), F.lit(10))
    phone = lambda form: F.regexp_replace(local, r"^(\d{3})(\d{3})(\d{4})$", form)
    card = F.regexp_replace(_digits(hit), r"(\d{4})(?=\d)", "$1.")
    return (F.when(kind == "phone", F.array(hit, phone("($1) $2-$3"), phone("$1-$2-$3"), phone("$1.$2.$3"), phone("$1 $2 $3")))
            .when(kind == "card", F.array(hit, card, F.regexp_replace(card, r"\.", " "), F.regexp_replace(card, r"\.", "-"))).otherwise(F.array(hit)))


def _proposals(placed: DataFrame) -> DataFrame:
    """Each proposal once per kind it may be, with ``label``: whether it equals a valid base span of that kind."""
    base = placed.where(F.col("source").isin(*KINDS)).where(_proper(F.col("source"), F.col("hit")))
    digits = F.length(_digits(F.col("hit")))
    kinds = F.when(F.col("source") == "mail", F.array(F.lit("email"))).otherwise(F.array_compact(F.array(
        F.when(digits.between(7, 15), F.lit("phone")), F.when(digits.between(12, 19), F.lit("card")),
        F.when(F.col("hit").rlike(r"^[0-9]{1,3}(?:(?:\.|\[\.\])[0-9]{1,3}){3}$"), F.lit("ip")))))
    offered = placed.where(F.col("source").isin(*PROPOSED)).withColumn("kind", F.explode(kinds)).drop("source")
    both = offered.withColumn("base", F.lit(False)).unionByName(base.withColumnRenamed("source", "kind").withColumn("base", F.lit(True)))
    same = both.groupBy("row", "fold", "kind", "start", "end", "hit").agg(F.bool_or("base").alias("label"), F.bool_or(~F.col("base")).alias("offered"), F.max("left").alias("left"), F.max("right").alias("right"))
    return _features(same.withColumn("left", F.coalesce("left", F.lit(""))).withColumn("right", F.coalesce("right", F.lit(""))))


class Trees:
    """Depth-two trees boosted on weighted patterns of small whole numbers, and calibrated thresholds by kind."""

    def __init__(self, x: np.ndarray, held: np.ndarray, positive: np.ndarray, negative: np.ndarray):
        self.trees, self.cuts = [], {}
        fit = ~held
        if not positive[fit].sum() or not negative[fit].sum():
            return
        rate = positive[fit].sum() / (positive[fit].sum() + negative[fit].sum())
        self.bias = float(np.log(rate / (1 - rate)))
        score, rng = np.full(len(x), self.bias), np.random.default_rng(1)
        total = np.where(fit, positive + negative, 0.0)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-score))
            gradient, curve = np.where(fit, positive, 0.0) - total * p, total * p * (1 - p)
            # each round sees some of the features, so that agreeing ones share the say
            some = np.sort(rng.choice(len(FEATURES), 5, replace=False))
            tree = self._split(x, gradient, curve, np.ones(len(x), dtype=bool), some, 2)
            score = score + self._value(tree, x)
            self.trees.append(tree)
        self._calibrate(x, score, np.where(held, positive, 0.0), np.where(held, positive + negative, 0.0))

    def _split(self, x, gradient, curve, at, some, depth):
        leaf = lambda m: STEP * float(gradient[m].sum() / (curve[m].sum() + 1))
        best, chosen = 1e-6, None
        if depth:
            whole = gradient[at].sum() ** 2 / (curve[at].sum() + 1)
            for f in some:
                for v in np.unique(x[at, f])[:-1]:
                    low = at & (x[:, f] <= v)
                    high = at & ~low
                    gain = gradient[low].sum() ** 2 / (curve[low].sum() + 1) + gradient[high].sum() ** 2 / (curve[high].sum() + 1) - whole
                    if gain > best:
                        best, chosen = gain, (int(f), int(v), low, high)
        if chosen is None:
            return leaf(at)
        f, v, low, high = chosen
        return f, v, self._split(x, gradient, curve, low, some, depth - 1), self._split(x, gradient, curve, high, some, depth - 1)

    def _value(self, tree, x):
        if isinstance(tree, float):
            return np.full(len(x), tree)
        f, v, low, high = tree
        return np.where(x[:, f] <= v, self._value(low, x), self._value(high, x))

    def _calibrate(self, x, score, positive, total):
        """Pooled adjacent violators on the held-out sums of each kind; the cut is where probabilities reach ``LEAST``."""
        for kind in range(1, len(KINDS) + 1):
            at = (x[:, 0] == kind) & (total > 0)
            blocks = []
            for s in np.unique(score[at]):
                here = at & (score == s)
                blocks.append([positive[here].sum(), total[here].sum(), float(s)])
                while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                    p, n, _ = blocks.pop()
                    blocks[-1][0] += p
                    blocks[-1][1] += n
            good = [b[2] for b in blocks if b[0] >= LEAST * b[1]]
            if good:
                self.cuts[kind] = min(good) - 1e-9

    def score(self) -> Column:
        def told(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            f, v, low, high = tree
            return F.when(F.col(f"f_{FEATURES[f]}") <= v, told(low)).otherwise(told(high))
        out = F.lit(self.bias)
        for tree in self.trees:
            out = out + told(tree)
        return out


def fit(proposals: DataFrame) -> Trees:
    """Trees from sums of all proposals, and of the other spellings of positives, by feature pattern."""
    names = [f"f_{f}" for f in FEATURES]
    spelled = _features(proposals.where("label").select("fold", "kind", F.explode(_spellings(F.col("kind"), F.col("hit"))).alias("hit"), "left", "right"))
    counted = spelled.select("fold", *names, F.lit(1).alias("p"), F.lit(0).alias("n")).unionByName(proposals.where("not label and offered").select("fold", *names, F.lit(0).alias("p"), F.lit(1).alias("n")))
    # each also without a cue and with one of its own, so that a corpus with few cues does not decide by chance ones
    counted = counted.withColumn("f_cue", F.explode(F.array("f_cue", F.lit(2), F.lit(3))))
    sums = counted.groupBy((F.col("fold") == HELD).alias("held"), *names).agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    rows = sums.orderBy(F.desc(F.col("p") + F.col("n")), "held", *names).limit(PATTERNS).collect()
    x = np.array([[r[c] for c in names] for r in rows], dtype=np.int64).reshape(-1, len(names))
    column = lambda c, t: np.array([r[c] for r in rows], dtype=t)
    return Trees(x, column("held", bool), column("p", float), column("n", float))


def _added(proposals: DataFrame, trees: Trees) -> DataFrame:
    """``row, kind, start, end`` of proposals over their cut; of proposals that meet, the likeliest, and none that meets a base span."""
    cut = F.lit(None).cast("double")
    for kind, least in trees.cuts.items():
        cut = F.when(F.col("f_kind") == kind, F.lit(least)).otherwise(cut)
    some = proposals.withColumn("score", trees.score()).where(F.col("label") | (F.col("score") >= cut))
    forth, back = Window.partitionBy("row").orderBy("start", "end", "kind"), Window.partitionBy("row").orderBy(F.desc("start"), F.desc("end"), F.desc("kind"))
    # Spark keeps running values only for frames that grow from the first row, so both orders are used
    behind = F.max(F.when(F.col("label"), F.col("end"))).over(forth.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.min(F.when(F.col("label"), F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    free = (some.withColumn("behind", behind).withColumn("ahead", ahead)
            .where(~F.col("label") & (F.coalesce("behind", F.lit(0)) <= F.col("start")) & (F.coalesce("ahead", F.col("end")) >= F.col("end"))))
    reach = F.max("end").over(forth.rowsBetween(Window.unboundedPreceding, -1))
    cluster = free.withColumn("reach", reach).withColumn("cluster", F.sum((F.coalesce("reach", F.lit(0)) <= F.col("start")).cast("int")).over(forth))
    mine = F.struct("score", -F.col("f_kind"), -F.col("start"), F.col("end"))
    return cluster.withColumn("best", F.max(mine).over(Window.partitionBy("row", "cluster"))).where(F.col("best") == mine).select("row", "kind", "start", "end")


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` and ``n_added`` of every row of ``doc_id, text``."""
    spans = _spans(docs)
    proposals = stored(_proposals(_placed(spans)), "proposals")
    trees = fit(proposals)
    base = proposals.where("label").select("row", "kind", "start", "end", F.lit(True).alias("base"))
    every = base.unionByName(_added(proposals, trees).withColumn("base", F.lit(False))) if trees.cuts else base
    one = F.struct("start", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("nth"), F.concat_ws(":", "kind", "start", "end").alias("span"), "base")
    told = lambda c: F.array_join(c["span"], ",")
    by_row = every.groupBy("row").agg(*[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS], F.sort_array(F.collect_list(one)).alias("s"))  # one document's own spans
    by_row = by_row.select("row", *[f"n_{k}" for k in KINDS], told(F.filter("s", lambda x: x["base"])).alias("base"), told(F.col("s")).alias("spans"), F.size(F.filter("s", lambda x: ~x["base"])).cast("long").alias("n_added"))
    return (spans.select("row", "doc_id").join(by_row, "row", "left")
            .select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
                    F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_added", F.lit(0).cast("long")).alias("n_added")))
