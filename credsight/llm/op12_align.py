"""Cross-tokenizer alignment by tokenizer spans.

Two public tokenizers cut ``space + text``: A (byte-level BPE, ``tokenizers``)
and B (pieces with byte fallback, ``sentencepiece``, which adds the space).
The aligned *groups* lie between the byte offsets where a token of A and one of
B both end; a *link* is a token of A and one of B whose bytes overlap.

* Coarse cuts are the tokenizers' own spans: character offsets of A's encoding
  (mapped to bytes) and the byte spans of B's proto.  (The installed
  sentencepiece calls its ``immutable_proto`` ``proto``.)
* A coarse cut between two tokens counts only where the spans meet and neither
  is empty.  Tokens between two such cuts share a character -- a multibyte
  character cut by A, byte-fallback pieces of B -- and are placed by the lengths
  of their decoded bytes.  Spans that contradict the decoded bytes are dropped:
  the bytes decide.
* Both tokenizers cut before a space that follows a word or ASCII sign (A by its
  split pattern, B because no piece holds a space after another character, which
  is checked when the model is read).  Such *chunks* are independent: those of up
  to 64 characters are remembered, so a word is aligned once per worker while it
  stays in the bounded memo, and the new ones are encoded side by side in one call.
* The number of documents that hold an id pair linked is counted from one
  partial sum per Arrow batch.  The counts return to the documents in blocks of at
  most about ``MAX_PAIRS`` pairs (all pairs of one A id in the same block), one
  scan of the stored pairs each, whatever their number: the broadcast is bounded.

A text that is null, empty, or whose joined A or B bytes differ from
``space + text`` has no tokens: zeros and empty lists.  Repeated rows are
documents of their own, also in the counts; null ids pass through; an empty
table gives an empty table.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsight.llm.common import map_arrow, stored, table

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
MEMO_CHARS, MEMO_ENTRIES, FRESH_ENTRIES, MAX_PAIRS = 64, 250_000, 250_000, 2_000_000
AT_ONCE = 400                     # chunks encoded as one text: the merge queues of both libraries stay small
NO_TOKENS = (0, 0, 0, b"", b"")
_PIECE = attrgetter("id", "begin", "end")


def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 signs stand for themselves, the
    other bytes for the characters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def piece_bytes(piece: str) -> bytes:
    """Bytes of a piece of B: U+2581 is a space, ``<0xHH>`` a byte."""
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


_OPEN = re.compile(r"[^!-~\w] ")


def closed(chunk: str) -> bool:
    """Both tokenizers cut between such an end and a space."""
    return chunk[-1:].isalnum() or "!" <= chunk[-1:] <= "~"


def chunks(text: str) -> list[str]:
    """``space + text`` cut before every space that follows a letter, digit or ASCII
    sign; spaces at the end stay with the last chunk.  Returned without the space
    that each chunk begins with."""
    if text[:1] != " " and text[-1:] != " " and not _OPEN.search(text):
        return text.split(" ")
    body = text.rstrip(" ")
    out, cur = [], []
    for p in body.split(" "):
        cur.append(p)
        if closed(p):
            out.append(" ".join(cur))
            cur = []
    if cur or not out:
        out.append(" ".join(cur))
    out[-1] += text[len(body):]
    return out


def token_ends(lengths: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Byte ends of the tokens: coarse cuts where two non-empty spans meet, decoded
    lengths from the last such cut between them.  Where the cuts and the bytes
    disagree, the bytes decide."""
    total = np.cumsum(lengths)
    if not len(total):
        return total
    cut = np.ones(len(total), bool)
    cut[:-1] = (end[:-1] == begin[1:]) & (end[:-1] > begin[:-1]) & (end[1:] > begin[1:])
    last = np.maximum.accumulate(np.where(cut, np.arange(len(total)), -1))     # latest coarse cut at or before a token
    base = np.where(last < 0, 0, end[last] - total[last])
    out = np.where(cut, end, base + total)
    return out if (out == total).all() else total


class Aligner:
    """Both tokenizers, their byte tables and the memo of short chunks."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"    # Spark's tasks share the cores
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True               # their strings are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letter = byte_letters()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(letter[c] for c in token) if all(c in letter for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [piece_bytes(p) for p in pieces]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.width = len(pieces)
        self.code = np.uint32 if len(self.a_bytes) * self.width < 1 << 32 else np.uint64
        # chunks are independent only if no piece goes on with a space
        self.cut = not any("▁" in p.lstrip("▁") for p in pieces)
        # chunks met again, and chunks met once
        self.memo: dict[str, tuple] = {}
        self.fresh: dict[str, tuple] = {}
        # ids as text, by what follows: another token of the same side, or the end of the side
        self.a_text, self.b_text = (np.array([f"{i}{end}".encode() for i in range(n) for end in ends], object)
                                    for n, ends in ((len(self.a_bytes), ",|"), (self.width, ",;")))
        self.some_without = False

    def _chunks(self, text: str) -> list[str]:
        return chunks(text) if self.cut else [text]

    def align(self, texts: list[str]) -> Iterator[tuple | None]:
        """(A ids, A ends, B ids, B ends) of every ``space + text``, ends in bytes; None where
        the token bytes differ from it."""
        a_bytes, b_bytes = self.a_bytes.__getitem__, self.b_bytes
        encodings = self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)
        protos = self.b.encode(texts, return_type="proto", num_threads=1)
        for text, enc, proto in zip(texts, encodings, protos):
            raw = b" " + text.encode()
            ids = enc.ids
            pieces = list(map(_PIECE, proto.pieces))
            a_tok = list(map(a_bytes, ids))
            b_tok = [b_bytes[i] for i, _, _ in pieces]
            if b"".join(a_tok) != raw or b"".join(b_tok) != raw:
                yield None
                continue
            a_span = np.fromiter(chain.from_iterable(enc.offsets), np.int64, 2 * len(a_tok)).reshape(-1, 2)
            if len(raw) != len(text) + 1:                 # characters to bytes
                begins = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
                a_span = np.append(begins, len(raw))[a_span]
            a_ids = np.array(ids, np.int64)
            b = np.fromiter(chain.from_iterable(pieces), np.int64, 3 * len(b_tok)).reshape(-1, 3)
            # B's spans are those of the text without the added space
            yield (a_ids, token_ends(self.a_size[a_ids], a_span[:, 0], a_span[:, 1]),
                   b[:, 0], token_ends(self.b_size[b[:, 0]], b[:, 1] + 1, b[:, 2] + 1))

    def run(self, todo: list[str]) -> list[tuple]:
        """(n_a, n_b, n_groups, groups as text, link codes) of every chunk, or ``NO_TOKENS``.
        Chunks are encoded side by side in one text, which both tokenizers cut between them."""
        found, base = [], 0
        for x in self.align([" ".join(todo[k:k + AT_ONCE]) for k in range(0, len(todo), AT_ONCE)]):
            if x is None:
                found = None
                break
            found.append((x[0], x[1] + base, x[2], x[3] + base))
            base = found[-1][1][-1]
        ends = np.cumsum([len(c.encode()) + 1 for c in todo])
        if found is not None:
            a_ids, a_end, b_ids, b_end = map(np.concatenate, zip(*found))
            a_last = np.append(b_end, -1)[np.searchsorted(b_end, a_end)] == a_end
            common = a_end[a_last]
        if found is None or not (np.append(common, -1)[np.searchsorted(common, ends)] == ends).all():
            if len(todo) == 1:
                self.some_without = True
                return [NO_TOKENS]
            half = len(todo) // 2
            return self.run(todo[:half]) + self.run(todo[half:])
        cuts = np.sort(np.concatenate([a_end, b_end]), kind="stable")
        cuts = cuts[np.append(cuts[1:] != cuts[:-1], True)]      # a link for each stretch between neighbouring cuts
        codes = (a_ids[np.searchsorted(a_end, cuts)] * self.width + b_ids[np.searchsorted(b_end, cuts)]).astype(self.code).tobytes()
        size = np.dtype(self.code).itemsize
        a_group, b_group = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
        a_upto, b_upto = np.searchsorted(a_end, common, "right"), np.searchsorted(b_end, common, "right")
        b_last = common[b_group] == b_end
        parts = np.empty(len(a_ids) + len(b_ids), object)
        # a group's A tokens come before its B tokens
        parts[np.arange(len(a_ids)) + np.append(0, b_upto)[a_group]] = self.a_text[2 * a_ids + a_last]
        parts[np.arange(len(b_ids)) + a_upto[b_group]] = self.b_text[2 * b_ids + b_last]
        parts = parts.tolist()
        at = [[0, *np.searchsorted(x, ends, "right").tolist()] for x in (a_end, b_end, common, cuts)]
        return [(a1 - a0, b1 - b0, g1 - g0, b"".join(parts[a0 + b0:a1 + b1]), codes[c0 * size:c1 * size])
                for a0, a1, b0, b1, g0, g1, c0, c1 in zip(*(y for x in at for y in (x, x[1:])))]

    def entries(self, texts: list[str | None]) -> Iterator[list[tuple] | None]:
        """Entries of every text's chunks; None for a text without tokens."""
        at = 0
        while at < len(texts):
            group, missing, size = [], set(), 0
            get = self.memo.get
            while at < len(texts) and size < 200_000:     # bounds the characters held at once
                cs = self._chunks(texts[at]) if texts[at] else []
                es = list(map(get, cs))
                if None in es:
                    missing.update(c for c, e in zip(cs, es) if e is None)
                group.append((cs, es))
                size += len(texts[at] or "")
                at += 1
            now = {c: self.fresh[c] for c in missing if c in self.fresh}
            again = list(now)
            new = [c for c in missing if c not in now]
            joint = [c for c in new if closed(c)] if self.cut else []
            now.update(zip(joint, self.run(joint) if joint else ()))
            for c in new:                                 # a text's end may be open to what would follow
                if c not in now:
                    now[c] = self.run([c])[0]
            for cs, es in group:
                if None in es:
                    es = [now[c] if e is None else e for c, e in zip(cs, es)]
                yield es if es and not (self.some_without and any(e is NO_TOKENS for e in es)) else None
            self._remember(again, new, now)

    def _remember(self, again: list[str], new: list[str], now: dict[str, tuple]) -> None:
        """Words met a second time stay longer than the many that never come again."""
        for c in again:
            self.memo[c] = self.fresh.pop(c)
        self.fresh.update((c, now[c]) for c in new if len(c) <= MEMO_CHARS)
        for kept, most in ((self.memo, MEMO_ENTRIES), (self.fresh, FRESH_ENTRIES)):
            if len(kept) > most:
                kept.clear()


_ALIGNERS: dict = {}


def aligner(paths: tuple[str, str]) -> Aligner:
    """One per Python worker."""
    if paths not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


def default_paths() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE)


def align(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, a_ids, a_ends, b_ids, b_ends, cuts): token ids, byte ends within
    ``space + text``, and the byte ends of the groups."""
    paths = paths or default_paths()

    def run(batch: pa.RecordBatch) -> dict:
        al = aligner(paths)
        out: dict[str, list] = {n: [] for n in ("a_ids", "a_ends", "b_ids", "b_ends", "cuts")}
        for t in batch.column(1):
            text = t.as_py()
            found = next(al.align([text])) if text else None
            rows = found if found is not None else [np.empty(0, np.int64)] * 4
            for name, r in zip(out, (*rows, np.intersect1d(rows[1], rows[3]))):
                out[name].append(r.tolist())
        return out | {"doc_id": batch.column(0)}

    arrays = ", ".join(f"{n} array<int>" for n in ("a_ids", "a_ends", "b_ids", "b_ends", "cuts"))
    d = docs.select("doc_id", "text")
    return map_arrow(d, run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, {arrays}")


def linked_pairs(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): ``pairs`` are
    the document's distinct linked id pairs as packed codes, ``times`` how often each is linked."""
    paths = paths or default_paths()

    def run(batch: pa.RecordBatch) -> dict:
        al = aligner(paths)
        out: dict[str, list] = {n: [] for n in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")}
        for es in al.entries(batch.column(1).to_pylist()):
            n_a, n_b, n_groups, groups, codes = zip(*es) if es else [()] * 5
            codes = np.frombuffer(b"".join(codes), al.code)
            uniq, times = np.unique(codes, return_counts=True)
            out["n_a"].append(sum(n_a))
            out["n_b"].append(sum(n_b))
            out["n_groups"].append(sum(n_groups))
            out["n_links"].append(len(codes))
            out["groups_sha256"].append(hashlib.sha256(b"".join(groups)[:-1]).hexdigest() if es else "")
            out["pairs"].append(uniq.tobytes())
            out["times"].append(times.astype(np.uint32).tobytes())
        return out | {"doc_id": batch.column(0)}

    d = docs.select("doc_id", "text")
    return map_arrow(d, run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, "
                             "n_groups long, n_links long, groups_sha256 string, pairs binary, times binary")


def _flat(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all rows of a binary column, and where each row begins (one more at the end)."""
    parts = [np.frombuffer(x.as_py(), dtype) for x in column]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return np.concatenate(parts) if parts else np.empty(0, dtype), starts


def pair_counts(links: DataFrame, code, width: int) -> DataFrame:
    """(a, pair, n): documents that hold the pair linked."""

    def run(batch: pa.RecordBatch) -> dict:
        pairs, n = np.unique(_flat(batch.column(0), code)[0], return_counts=True)
        return {"a": (pairs // code(width)).astype(np.int64), "pair": pairs.astype(np.int64), "n": n}

    return (map_arrow(links.select("pairs"), run, "a long, pair long, n long")
            .groupBy("a", "pair").agg(F.sum("n").alias("n")))


def with_counts(links: DataFrame, code, width: int, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """``links`` plus ``n_best`` and ``count_sum``."""
    spark = links.sparkSession
    counts = stored(spark, pair_counts(links, code, width), "op12-counts")
    best = counts.groupBy("a").agg(F.max("n").alias("top"))
    blocks = max(1, -(-counts.count() // max_pairs))
    rows = counts.join(best, "a").select(
        "pair", "n", (F.col("n") == F.col("top")).alias("best"), F.pmod(F.xxhash64("a"), F.lit(blocks)).alias("b"))
    rows = stored(spark, rows, "op12-pairs")
    out = links.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    names = out.columns
    for b in range(blocks):
        part = rows.where(F.col("b") == b).select("pair", "n", "best").toPandas().sort_values("pair")
        sent = spark.sparkContext.broadcast(tuple(part[c].to_numpy() for c in ("pair", "n", "best")))

        def run(batch: pa.RecordBatch, sent=sent) -> dict:
            known, n, is_best = sent.value
            cols = {c: batch.column(i) for i, c in enumerate(names)}
            pairs, starts = _flat(cols["pairs"], code)
            times = _flat(cols["times"], np.uint32)[0].astype(np.int64)
            if len(known) and len(pairs):
                pairs = pairs.astype(np.int64)
                at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
                times = np.where(known[at] == pairs, times, 0)
                for name, value in (("n_best", times * is_best[at]), ("count_sum", times * n[at])):
                    total = np.concatenate([[0], np.cumsum(value)])
                    cols[name] = pa.array(total[starts[1:]] - total[starts[:-1]] + cols[name].to_numpy(), pa.int64())
            return cols

        out = map_arrow(out, run, out.schema)
        if b + 1 < blocks:
            out = stored(spark, out, "op12-sums")
    return out


def alignment_digests(docs: DataFrame, paths: tuple[str, str] | None = None, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    paths = paths or default_paths()
    al = aligner(paths)
    links = stored(docs.sparkSession, linked_pairs(docs, paths), "op12-links")
    found = with_counts(links, al.code, al.width, max_pairs)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_digests(table(spark, sf_dir, "documents"))
