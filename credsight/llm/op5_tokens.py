"""Token counts by trie-shared dynamic programming over a unigram vocabulary.

The vocabulary is a public rank file read as a unigram model: a piece of rank r
has the log-probability -ln(r + 1) - ln(H), Zipf's law over the V ranks
(H = sum of 1 / (r + 1)).  A pre-token (a match of the split pattern) is cut
into the pieces of highest total log-probability, the fewest pieces on a tie;
every single byte is a piece, so each text has such a cut.

The distinct pre-tokens of a batch go into a trie.  The best score of a prefix
depends on that prefix alone, so each trie node holds its forward score and
count, computed once for all pre-tokens that begin with it; the node where a
pre-token ends has its token count.  Pieces that end at a node are found by
walking the reversed pieces backwards, which stops as soon as no piece fits.
The trie and a memo of finished pre-tokens live on between the batches of a
Python worker and are emptied at a fixed size, which changes no result.

Null or empty text has no tokens.  Repeated rows give repeated results; other
columns are not read.  Nothing is shuffled.
"""

from __future__ import annotations

import math
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from credsight.llm.common import map_arrow, schema_with, table

VOCABULARY = "byte_bpe_50k.tiktoken"
MAX_NODES, MAX_MEMO = 400_000, 300_000


def unigram_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    """Zipf log-probabilities of the pieces by rank."""
    h = math.log(math.fsum(1.0 / (r + 1) for r in ranks.values()))
    return {p: -math.log(r + 1) - h for p, r in ranks.items()}


class Reversed:
    """Trie of the reversed pieces: ``step[state << 8 | byte]`` and the score of a piece that is complete there."""

    def __init__(self, scores: dict[bytes, float]):
        self.step: dict[int, int] = {}
        self.score: list[float | None] = [None]
        for piece, s in scores.items():
            state = 0
            for b in reversed(piece):
                key = state << 8 | b
                nxt = self.step.get(key)
                if nxt is None:
                    nxt = self.step[key] = len(self.score)
                    self.score.append(None)
                state = nxt
            self.score[state] = s


class ForwardTrie:
    def __init__(self, pieces: Reversed):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best = array("d", [0.0])        # forward score of the prefix
        self.count = array("l", [0])         # pieces of its best cut

    def insert(self, token: bytes) -> int:
        """Token count of one pre-token; only nodes not yet in the trie are computed."""
        child, best, count = self.child, self.best, self.count
        step, score = self.pieces.step.get, self.pieces.score
        path = [0]
        node = 0
        for d, byte in enumerate(token):
            key = node << 8 | byte
            nxt = child.get(key)
            if nxt is None:
                top, few, state = -math.inf, 0, 0
                for j in range(d, -1, -1):
                    state = step(state << 8 | token[j])
                    if state is None:
                        break
                    s = score[state]
                    if s is not None:
                        at = path[j]
                        v, c = best[at] + s, count[at] + 1
                        if v > top or v == top and c < few:
                            top, few = v, c
                nxt = child[key] = len(best)
                best.append(top)
                count.append(few)
            node = nxt
            path.append(node)
        return count[node]


class Counter:
    def __init__(self, path: str, pattern: str):
        from credsight.llm.op1_bpe import load_ranks
        self.find = regex.compile(pattern).findall
        self.trie = ForwardTrie(Reversed(unigram_scores(load_ranks(path))))
        self.memo: dict[str, int] = {}

    def count(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text of a batch."""
        memo = self.memo
        if len(memo) > MAX_MEMO:
            memo.clear()
        out = []
        for t in texts:
            toks = self.find(t) if t else []
            new = {x for x in toks if x not in memo}
            if new:
                trie = self.trie
                for x in sorted(new):
                    if len(trie.best) > MAX_NODES:
                        trie.clear()
                    memo[x] = trie.insert(x.encode("utf-8", "surrogatepass"))
            out.append((len(toks), sum(map(memo.__getitem__, toks))))
            if len(memo) > MAX_MEMO:
                memo.clear()
        return out


_COUNTERS: dict[tuple[str, str], Counter] = {}


def counter(path: str, pattern: str) -> Counter:
    if (path, pattern) not in _COUNTERS:
        _COUNTERS[path, pattern] = Counter(path, pattern)
    return _COUNTERS[path, pattern]


def token_counts(docs: DataFrame, path: str | None = None, pattern: str | None = None,
                 keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns plus n_pretokens and n_tokens of the whole text."""
    if path is None or pattern is None:
        import public_tokenizers as P
        path, pattern = path or P.path(VOCABULARY), pattern or P.PATTERN
    d = docs.select(*keep, docs[text].alias("_llm_text"))

    def run(batch: pa.RecordBatch) -> dict:
        got = counter(path, pattern).count(batch.column(len(keep)).to_pylist())
        return {c: batch.column(i) for i, c in enumerate(keep)} | {
            "n_pretokens": [a for a, _ in got], "n_tokens": [b for _, b in got]}

    return map_arrow(d, run, schema_with(docs.select(*keep), "n_pretokens long, n_tokens long"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
