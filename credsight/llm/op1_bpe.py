"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Every match of the split pattern (a pre-token) is encoded on its own.  The
pieces of a pre-token form a doubly linked list; each adjacent pair that is a
vocabulary entry waits in the bucket of its merge rank.  A two-level bitmap
over the ranks (words of 256 bits under one summary word) says which buckets
hold entries: two find-first-set steps give the lowest rank, whatever the
length of the pre-token.  An entry whose pair has changed since is stale and skipped.  Every
merge removes one list node and adds at most two entries, so a pre-token of n
bytes costs O(n log n), also without any white space in the text.

Null or empty text has no ids.  Rows are independent: repeated rows give
repeated results, other columns are passed through.  Nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsight.llm.common import map_arrow, only_caches_of, schema_with, table, worker_cache

VOCABULARY = "byte_bpe_50k.tiktoken"


def load_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary file: one ``base64(bytes) rank`` per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encode_pretoken(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token.

    ``top`` has a bit per bitmap word in use and ``low[word]`` a bit per rank
    with a non-empty bucket; ``bucket[rank]`` is a heap of list positions, so
    equal ranks merge from the left.  The queue is written inline: most
    pre-tokens are a few bytes long and calls would dominate.
    """
    get = ranks.get
    whole = get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))          # node i covers piece[i:end[i]]; its successor starts at end[i]
    prev = list(range(-1, n - 1))
    pair = [-1] * n                      # rank of node i joined with its successor, -1: none
    bucket: dict[int, list[int]] = {}
    for i in range(n - 1):
        r = get(piece[i:i + 2])
        if r is not None:
            pair[i] = r
            if r in bucket:
                bucket[r].append(i)      # ascending, hence a heap
            else:
                bucket[r] = [i]
    top, low = 0, {}
    for r in bucket:
        w = r >> 8
        top |= 1 << w
        low[w] = low.get(w, 0) | 1 << (r & 255)
    while top:
        w = (top & -top).bit_length() - 1
        x = low[w]
        bit = x & -x
        rank = w << 8 | bit.bit_length() - 1
        b = bucket[rank]
        i = heappop(b)
        if not b:
            del bucket[rank]
            low[w] = x = x ^ bit
            if not x:
                top ^= 1 << w
        if pair[i] != rank:
            continue                     # stale
        j = end[i]
        e = end[i] = end[j]
        pair[j] = pair[i] = -1
        p = prev[i]
        if e < n:
            prev[e] = i
            r = get(piece[i:end[e]])
            if r is not None:
                pair[i] = r
                if r in bucket:
                    heappush(bucket[r], i)
                else:
                    bucket[r] = [i]
                    w = r >> 8
                    top |= 1 << w
                    low[w] = low.get(w, 0) | 1 << (r & 255)
        if p >= 0:
            r = get(piece[p:e])
            if r is None:
                pair[p] = -1
            else:
                pair[p] = r
                if r in bucket:
                    heappush(bucket[r], p)
                else:
                    bucket[r] = [p]
                    w = r >> 8
                    top |= 1 << w
                    low[w] = low.get(w, 0) | 1 << (r & 255)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class Codec:
    """Encoder and decoder with a bounded memo of pre-tokens.

    Ids travel as decimal text joined by spaces, the form the digests use.
    """

    MEMO = 800_000      # entries of one generation; two are kept, so frequent pre-tokens stay

    def __init__(self, path: str, pattern: str, memo: int = MEMO):
        self.most = memo
        self.ranks = load_ranks(path)
        self.find = regex.compile(pattern).findall
        self.piece = {str(i).encode(): b for b, i in self.ranks.items()}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _pretoken(self, t: str) -> bytes:
        got = self.memo.get(t) or self.older.get(t)
        if got is None:
            got = b" ".join(b"%d" % x for x in encode_pretoken(t.encode(), self.ranks))
        if len(t) <= 64:
            if len(self.memo) >= self.most:
                self.memo, self.older = {}, self.memo
            self.memo[t] = got
        return got

    def encode(self, text: str) -> bytes:
        toks = self.find(text)
        out = list(map(self.memo.get, toks))
        if None in out:
            for i, got in enumerate(out):
                if got is None:
                    out[i] = self._pretoken(toks[i])
        return b" ".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.piece.__getitem__, ids.split()))


_CODECS = worker_cache("op1")


def codec(path: str, pattern: str, memo: int = Codec.MEMO) -> Codec:
    """One codec per Python worker, kept between tasks."""
    key = path, pattern, memo
    if key not in _CODECS:
        _CODECS[key] = Codec(*key)
    return _CODECS[key]


def _source(path: str | None, pattern: str | None) -> tuple[str, str]:
    if path is None or pattern is None:
        import public_tokenizers as P
        path, pattern = path or P.path(VOCABULARY), pattern or P.PATTERN
    return path, pattern


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None,
           text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` plus ``out`` array<int>: token ids of the whole text."""
    path, pattern = _source(path, pattern)
    names = docs.columns

    def run(batch: pa.RecordBatch) -> dict:
        c = codec(path, pattern)
        cols = {n: batch.column(i) for i, n in enumerate(names)}
        return cols | {out: [[int(x) for x in c.encode(t or "").split()]
                             for t in cols[text].to_pylist()]}

    return map_arrow(docs, run, schema_with(docs, f"{out} array<int>"))


def decode(frame: DataFrame, path: str | None = None, pattern: str | None = None,
           ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``frame`` plus ``out`` binary: the bytes of the ids; null ids give none."""
    path, pattern = _source(path, pattern)
    names = frame.columns

    def run(batch: pa.RecordBatch) -> dict:
        c = codec(path, pattern)
        cols = {n: batch.column(i) for i, n in enumerate(names)}
        return cols | {out: [c.decode(b" ".join(b"%d" % i for i in x or []))
                             for x in cols[ids].to_pylist()]}

    return map_arrow(frame, run, schema_with(frame, f"{out} binary"))


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None,
               keep: tuple[str, ...] = ("doc_id",), text: str = "text", memo: int = Codec.MEMO) -> DataFrame:
    """Encode, decode the ids again and return both digests with the id count; ``memo``
    bounds the pre-tokens that a worker remembers."""
    path, pattern = _source(path, pattern)
    d = docs.select(*keep, F.col(text).alias("_llm_text"))

    def run(batch: pa.RecordBatch) -> dict:
        only_caches_of("op1")
        c = codec(path, pattern, memo)
        n, ids_sha, dec_sha = [], [], []
        for t in batch.column(len(keep)):
            ids = c.encode(t.as_py() or "")
            n.append(ids.count(b" ") + 1 if ids else 0)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            dec_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return {k: batch.column(i) for i, k in enumerate(keep)} | {
            "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": dec_sha}

    schema = schema_with(docs.select(*keep), "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return map_arrow(d, run, schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
