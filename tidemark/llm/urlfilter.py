"""Operator 3: URL filters by a bit-parallel wildcard automaton.

All glob rules lie one after another in one row of bits, cut into 64-bit words. Reading a byte of the canonical URL
(lower-case host, then path) shifts every state at once and masks it with the states the byte may enter; a star is a state
that some bytes leave set. URLs of a batch are read in step, so a step is a few numpy operations for all rules and URLs.

Globs: ``?`` is one byte but ``/``, ``*`` any run without ``/``, ``**`` any run; all else stands for itself, from the first
byte to the last. Of the list rules that fit, the longest decides (equal lengths: the one given first); where none fits,
the globs' own verdict: block if any glob fits, else allow.

Defined results: a null URL or one without ``://`` has empty host and path; repeated rows give one row each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (verdict, rule) of the list: host, then the start of the path.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Globs that block where no rule of the list fits: addresses of adverts, tracking, log-in and shop pages.
GLOBS = ["ads.**", "*.ads.**", "adserver.**", "track.**", "**/wp-login*", "**/login", "**/login/**", "**/cart/**", "**/checkout/**", "**.exe", "**.zip"]
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
U64 = np.uint64


class Automaton:
    """Masks of a list of globs over bytes."""

    def __init__(self, globs: list[str]):
        states: list[tuple[int, ...]] = []  # of each state, the bytes that enter it
        loops: list[str] = []  # "", "*" or "**": the run that may follow a state
        starts, ends, lead = [], [], []
        for glob in globs:
            data, i = glob.encode("utf-8"), 0
            starts.append(len(states))
            # a state before the first byte, entered by the start of the text alone
            states.append(()), loops.append("")
            while i < len(data):
                if data[i:i + 1] == b"*":
                    double = data[i:i + 2] == b"**"
                    loops[-1] = "**" if double or loops[-1] == "**" else "*"
                    i += 1 + double
                    continue
                states.append(tuple(b for b in range(256) if b != 47) if data[i:i + 1] == b"?" else (data[i],)), loops.append("")
                i += 1
            ends.append(len(states) - 1)
        self.words = max(1, -(-len(states) // 64))
        self.enter, self.loop = np.zeros((256, self.words), U64), np.zeros((256, self.words), U64)
        bit = lambda s: (s // 64, U64(1) << U64(s % 64))
        for s, (entered, run) in enumerate(zip(states, loops)):
            w, b = bit(s)
            self.enter[list(entered), w] |= b
            if run:
                self.loop[[c for c in range(256) if run == "**" or c != 47], w] |= b
        self.first = np.zeros(self.words, U64)
        for s in starts:
            w, b = bit(s)
            self.first[w] |= b
        self.ends = [bit(s) for s in ends]

    def match(self, texts: list[bytes]) -> np.ndarray:
        """(text, glob) truth table; texts are read in step, shorter ones drop out as they end."""
        length = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-length, kind="stable")
        state = np.broadcast_to(self.first, (len(texts), self.words)).copy()
        begin = np.concatenate([[0], np.cumsum(length)])[:-1][order] if len(texts) else length
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        alive = np.searchsorted(-length[order], -np.arange(length.max(initial=0)), side="left")  # how many are longer than each step
        for step, n in enumerate(alive.tolist()):
            byte = data[begin[:n] + step]
            now = state[:n]
            moved = now << U64(1)
            moved[:, 1:] |= now[:, :-1] >> U64(63)
            state[:n] = (moved & self.enter[byte]) | (now & self.loop[byte])
        out = np.empty((len(texts), len(self.ends)), dtype=bool)
        for g, (w, b) in enumerate(self.ends):
            out[order, g] = (state[:, w] & b) != 0
        return out


def parts(url: str | None) -> tuple[bytes, bytes]:
    """Host (A-Z lower-cased) and path of a URL."""
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return b"", b""
    data = rest.encode("utf-8")
    stop = min((i for i in (data.find(b"?"), data.find(b"#")) if i >= 0), default=len(data))
    data = data[:stop]
    cut = data.find(b"/")
    host, path = (data, b"") if cut < 0 else (data[:cut], data[cut:])
    return host.translate(_LOWER), path


def escaped(rule: str) -> list[str]:
    """The globs of a list rule: its host and every subdomain, any path that starts with the rule's."""
    return [f"{rule}**", f"*.{rule}**"]


OUT = "page_id long, host string, path string, rule string, verdict string, globs array<string>"
_OUT = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("globs", pa.list_(pa.string()))])


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] | None = None, globs: list[str] | None = None) -> DataFrame:
    """``page_id, url`` to ``page_id, host, path, rule, verdict, globs``. Rules and globs are parameters of bounded size."""
    rules, globs = RULES if rules is None else rules, GLOBS if globs is None else globs
    for _, rule in rules:
        if "*" in rule or "?" in rule:
            raise ValueError(f"a list rule has no wildcards: {rule}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton([g for _, r in rules for g in escaped(r)] + globs)
        for batch in batches:
            cut = [parts(u) for u in batch.column(1).to_pylist()]
            hits = machine.match([h + p for h, p in cut])
            rows = []
            for page, (host, path), hit in zip(batch.column(0).to_pylist(), cut, hits.tolist()):
                fits = [r for i, r in enumerate(rules) if hit[2 * i] or hit[2 * i + 1]]
                met = [g for g, h in zip(globs, hit[2 * len(rules):]) if h]
                best = max(fits, key=lambda r: len(r[1]), default=None)
                rows.append((page, host.decode("utf-8"), path.decode("utf-8"), best and best[1], best[0] if best else "block" if met else "allow", met))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _OUT.types)], schema=_OUT)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(run, OUT)
