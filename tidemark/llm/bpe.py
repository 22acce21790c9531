"""Operator 2: byte-level BPE by a global shuffle of distinct words.

Texts are cut into blocks of documents. Every block sends each of its distinct words (pre-tokens with their leading
blank) once to the bucket of the word's hash, where a word is encoded once for the whole corpus; the ids go back to
the block, and each document is put together from its words' positions. Words and positions travel packed: one row per
(block, bucket) or block instead of one per word.

Defined results: null or empty text gives no ids; repeated rows and repeated or null ``doc_id`` give one row each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import partitions

#: Characters that Unicode calls white space, as the rank files' own pattern engine has them.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Cuts where the full pattern cuts around white space; each piece is then cut and encoded without its neighbours.
CHUNK = regex.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Bounds of a block of documents, in characters of text.
BLOCK_MIN, BLOCK_MAX = 1 << 17, 1 << 23
#: Buckets of words at most; their rows are packed, and more buckets than a block has words would undo that.
BUCKETS = 4096
#: Ends of words that leave the bucket as it is, so that forms of one word meet and share their pre-tokens.
ENDS = b" .,;:!?#$%&*)\"'"
#: Words an encoding task remembers; beyond that it starts anew, so memory is bounded.
REMEMBERED = 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a rank file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: join the adjacent pair of lowest rank, leftmost first, until none is in the vocabulary."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > 200:
        return _merge_long(word, ranks)
    parts = [word[i:i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap over linked parts, for words where the plain loop would be quadratic."""
    n = len(word)
    end, prev, nxt = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or end[j] != stop or not alive[i] or end[i] != j:
            continue
        end[i], alive[j], nxt[i] = stop, False, nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
            if (r := ranks.get(word[i:end[nxt[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        if prev[i] >= 0 and (r := ranks.get(word[prev[i]:stop])) is not None:
            heapq.heappush(heap, (r, prev[i], stop))
    return [ranks[word[i:end[i]]] for i in range(n) if alive[i]]


def _bytes(values: list[int]) -> bytes:
    return np.asarray(values, dtype="<u4").tobytes()


def _packed(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.asarray(values, dtype="<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _edges(sizes: bytes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(_unpacked(sizes), dtype=np.int64)])


PACKED = "key long, block long, docs array<long>, payload binary, sizes binary"
_PACKED = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("docs", pa.list_(pa.int64())), ("payload", pa.binary()), ("sizes", pa.binary())])


def _blocks(chars: int, buckets: int):
    """Documents to packed rows: per block its documents' word positions, per (block, bucket) the distinct words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        squeeze = zstandard.ZstdCompressor(level=1)
        seen: dict[str, int] = {}
        ids, codes, missing, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, size
            words = [w.encode("utf-8") for w in seen]
            bucket = np.fromiter((xxhash.xxh32_intdigest(w.rstrip(ENDS)) for w in words), dtype=np.int64, count=len(words)) % buckets
            order = np.argsort(bucket, kind="stable")
            # positions are stored as places in the order by bucket, in which the ids come back
            place = np.empty(len(words), dtype=np.uint32)
            place[order] = np.arange(len(words), dtype=np.uint32)
            flat = place[np.concatenate(codes)] if codes and len(words) else np.empty(0, np.uint32)
            rows = [(-1 - number, number, [x if x is not None else 0 for x in ids], _packed(flat), bytes(missing) + _packed([len(c) for c in codes]))]
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edges)):
                group = [words[i] for i in order[edges[b]:edges[b + 1]]]
                rows.append((int(b), number, None, squeeze.compress(b"".join(group)), _packed([len(w) for w in group])))
            number += 1
            seen.clear(), ids.clear(), codes.clear(), missing.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PACKED.types)], schema=_PACKED)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = CHUNK.findall(text or "")
                codes.append(np.fromiter((seen.setdefault(w, len(seen)) for w in found), dtype=np.uint32, count=len(found)))
                ids.append(doc)
                missing.append(doc is None)
                size += len(text or "") + 64
                if size >= chars:
                    yield flush()
        if ids:
            yield flush()
    return run


def _encode(ranks_of, pattern: str):
    """Rows of words, all of a bucket in one task, to rows of ids for the words' block; each word is encoded once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, split = ranks_of.value[1], regex.compile(pattern)
        known: dict[bytes, bytes] = {}
        parts: dict[str, bytes] = {}

        def encoded(word: bytes) -> bytes:
            out = []
            for m in split.findall(word.decode("utf-8")):
                got = parts.get(m)
                if got is None:
                    if len(parts) >= REMEMBERED:
                        parts.clear()
                    got = parts[m] = _bytes(merge(m.encode("utf-8"), ranks))
                out.append(got)
            return b"".join(out)

        for batch in batches:
            rows = []
            for key, block, payload, sizes in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if key < 0:
                    continue
                text, edge = zstandard.ZstdDecompressor().decompress(payload), _edges(sizes).tolist()
                out = []
                for i in range(len(edge) - 1):
                    w = text[edge[i]:edge[i + 1]]
                    got = known.get(w)
                    if got is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        got = known[w] = encoded(w)
                    out.append(got)
                rows.append((-1 - block, key, _packed(np.frombuffer(b"".join(out), dtype="<u4")), _packed([len(x) // 4 for x in out])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _IDS.types)], schema=_IDS)
    return run


IDS = "key long, bucket long, payload binary, sizes binary"
_IDS = pa.schema([("key", pa.int64()), ("bucket", pa.int64()), ("payload", pa.binary()), ("sizes", pa.binary())])
TOKENS = "doc_id long, n_tokens long, ids array<int>, decoded binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _assemble(ranks_of, digest: bool):
    """One block: its documents' positions and its words' ids to ids per document; decoding looks ids up in the token-byte table."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())] + ([("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digest else [("ids", pa.list_(pa.int32())), ("decoded", pa.binary())]))
        columns: list[list] = [[], [], [], []]
        if left.num_rows and left["key"][0].as_py() < 0:
            if left.num_rows != 1:
                raise RuntimeError("a block was made twice")
            token = _token_bytes(ranks_of)
            words: list[np.ndarray] = []
            for part in right.sort_by("bucket").select(["payload", "sizes"]).to_pylist():
                flat, edge = _unpacked(part["payload"]), _edges(part["sizes"]).tolist()
                words += [flat[a:b] for a, b in zip(edge, edge[1:])]
            row = left.select(["docs", "payload", "sizes"]).to_pylist()[0]
            n = len(row["docs"])
            missing, sizes, codes = row["sizes"][:n], _unpacked(row["sizes"][n:]), _unpacked(row["payload"])
            start = 0
            for doc, size, none in zip(row["docs"], sizes.tolist(), missing):
                got = [words[c] for c in codes[start:start + size].tolist()]
                start += size
                ids = np.concatenate(got) if got else np.empty(0, "<u4")
                text = b"".join([token[i] for i in ids.tolist()])
                columns[0].append(None if none else doc)
                columns[1].append(len(ids))
                columns[2].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() if digest else ids.astype(np.int32))
                columns[3].append(hashlib.sha256(text).hexdigest() if digest else text)
        return pa.table([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)
    return run


_TABLES: dict[str, list[bytes]] = {}


def _token_bytes(ranks_of) -> list[bytes]:
    """The token-byte table as a list by id, built once per worker and vocabulary."""
    name, ranks = ranks_of.value
    if name not in _TABLES:
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for word, rank in ranks.items():
            table[rank] = word
        _TABLES[name] = table
    return _TABLES[name]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, digest: bool = False) -> DataFrame:
    """``doc_id, text`` to ``doc_id, n_tokens, ids, decoded``, or with ``digest`` to their SHA-256 sums.

    ``ranks`` is a fixed vocabulary (its size does not grow with the data), so it is broadcast.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = partitions(spark)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, ranks))
    packed = docs.mapInArrow(_blocks(min(max(chars // (3 * n), BLOCK_MIN), BLOCK_MAX), min(n, BUCKETS)), PACKED).repartition(n, "key")
    ids = packed.mapInArrow(_encode(shared, pattern), IDS)
    return packed.groupBy("key").cogroup(ids.groupBy("key")).applyInArrow(_assemble(shared, digest), DIGESTS if digest else TOKENS)
