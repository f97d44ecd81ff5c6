"""Token counts by dynamic programming over a trie of pre-tokens.

A text is split into pre-tokens by a fixed pattern; distinct ones are inserted
into a trie, byte by byte.  A node's forward score is the best sum of unigram
scores over all ways to cut the bytes that lead to it into vocabulary tokens,
and is computed once however many pre-tokens share the prefix.  Each terminal
keeps its token count, so a text's count is a sum of look-ups.

Scale: the vocabulary is read once and sent to every task.  Every task has a trie
of its own over the texts that it reads; nothing is shuffled or gathered.  A trie
that would outgrow ``MOST_NODES`` is started anew, which costs time but changes no
count; a pre-token of over ``LONG`` bytes is cut by the same sums without nodes,
of which only as many are kept as the longest token has bytes.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary's file is by default, and the pattern that its publishers split texts by.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MOST_NODES, LONG = 2_000_000, 4096


def scores(path: str = VOCABULARY) -> dict[bytes, float]:
    """Unigram scores of the tokens of a published rank file: log probabilities by Zipf's law on the rank.

    A single byte that the file lacks scores less than any token, so that every
    text can be cut.
    """
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    total = math.log(sum(1 / (r + 1) for r in ranks.values()))
    found = {token: -math.log(rank + 1) - total for token, rank in ranks.items()}
    least = min(found.values()) - 1.0
    return {bytes([b]): least for b in range(256)} | found


class Trie:
    """Distinct pre-tokens; each node keeps its parent, byte, forward score and token count."""

    def __init__(self, unigrams: dict[bytes, float]) -> None:
        self.unigrams = unigrams
        self.longest = max(map(len, unigrams))
        # Byte strings that end some token, by length: where none does, no longer one need be tried.
        self.endings = {t[i:] for t in unigrams for i in range(len(t))}
        self.clear()

    def clear(self) -> None:
        self.children: dict[tuple[int, int], int] = {}
        self.best: list[float] = [0.0]
        self.count: list[int] = [0]
        self.terminal: dict[str, int] = {}

    def tokens(self, pretoken: str) -> int:
        """How many tokens the best cut of a pre-token has; of equally good cuts, the fewest."""
        known = self.terminal.get(pretoken)
        if known is None:
            data = pretoken.encode(errors="replace")
            if len(data) > LONG:
                return self._rolled(data)
            found = self._insert(data)
            known = self.terminal[pretoken] = found
        return known

    def _ending(self, data: bytes, end: int, before: Callable[[int], tuple[float, int]]) -> tuple[float, int]:
        """Best score and fewest tokens of the bytes up to ``end``, from those of the beginnings that a token may follow."""
        best, count = -math.inf, 0
        for k in range(1, min(end, self.longest) + 1):
            piece = data[end - k : end]
            if piece not in self.endings:
                break
            score = self.unigrams.get(piece)
            if score is not None:
                found, n = before(end - k)
                found, n = found + score, n + 1
                if found > best or found == best and n < count:
                    best, count = found, n
        return best, count

    def _insert(self, data: bytes) -> int:
        if len(self.best) + len(data) > MOST_NODES:
            self.clear()
        path, node = [0], 0
        for i, byte in enumerate(data):
            child = self.children.get((node, byte))
            if child is None:
                best, count = self._ending(data, i + 1, lambda at: (self.best[path[at]], self.count[path[at]]))
                child = self.children[node, byte] = len(self.best)
                self.best.append(best)
                self.count.append(count)
            node = child
            path.append(node)
        return self.count[node]

    def _rolled(self, data: bytes) -> int:
        """The count of a long pre-token, whose prefixes are hardly shared."""
        kept = [(0.0, 0)] * (self.longest + 1)
        for end in range(1, len(data) + 1):
            kept[end % len(kept)] = self._ending(data, end, lambda at: kept[at % len(kept)])
        return kept[len(data) % len(kept)][1]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_pretokens, n_tokens for every row of ``docs`` (doc_id, text; other columns play no part).

    ``vocabulary`` is the path of a rank file, which the driver reads.  Null and
    empty texts have no tokens.  Repeated rows stay repeated; a null doc_id is
    kept; an empty table gives no rows.
    """
    unigrams = docs.sparkSession.sparkContext.broadcast(scores(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, split = None, regex.compile(PATTERN)
        for batch in batches:
            trie = trie or Trie(unigrams.value)
            whole, n_tokens = [], []
            for text in batch.column(1):
                found = split.findall(text.as_py() or "")
                whole.append(len(found))
                n = 0
                for p in found:
                    known = trie.terminal.get(p)
                    n += trie.tokens(p) if known is None else known
                n_tokens.append(n)
                if len(trie.terminal) > MOST_NODES:
                    trie.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
