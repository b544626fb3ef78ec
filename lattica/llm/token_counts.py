"""Unigram token counts by dynamic programming over a trie of pre-tokens.

Distinct pre-tokens are inserted in a trie. A new node takes its best score and
token count from its ancestors, once for all pre-tokens that share the prefix; the
counts of the pre-tokens themselves are kept at their ends.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

_MARK = "▁"
_MAX_NODES = 600_000
_MAX_WORDS = 250_000


def zipf_scores(pieces: list[str]) -> dict[str, float]:
    """Log probabilities of pieces that are listed from frequent to rare."""
    total = math.log(sum(1 / (k + 2.7) for k in range(len(pieces))))
    return {p: -math.log(k + 2.7) - total for k, p in enumerate(pieces)}


def pieces_of(model_file: str) -> list[str]:
    """Pieces of a sentencepiece model, best first, without control, unknown and byte pieces."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_file)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return [sp.id_to_piece(i) for i in sorted(plain, key=lambda i: (-sp.get_score(i), i))]


class Trie:
    """Best segmentation of every prefix inserted so far: score, and tokens negated, so that of equal scores fewer tokens win."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10.0
        self.reset()

    def reset(self) -> None:
        self.children: dict[tuple[int, str], int] = {}
        self.best: list[tuple[float, int]] = [(0.0, 0)]
        self.words: dict[bytes, int] = {}

    def insert(self, word: str) -> int:
        """Tokens of a pre-token."""
        path, node, string = [0], 0, _MARK + word
        for end, letter in enumerate(string, 1):
            child = self.children.get((node, letter))
            if child is None:
                size = 1 if letter == _MARK else len(letter.encode())
                before = self.best[node]
                best = (before[0] + self.unknown * size, before[1] - size)
                for start in range(max(0, end - self.longest), end):
                    score = self.scores.get(string[start:end])
                    if score is not None:
                        before = self.best[path[start]]
                        best = max(best, (before[0] + score, before[1] - 1))
                child = len(self.best)
                self.children[node, letter] = child
                self.best.append(best)
            node = child
            path.append(node)
        return -self.best[node][1]

    def count(self, word: bytes) -> int:
        n = self.words.get(word)
        if n is None:
            if len(self.best) > _MAX_NODES or len(self.words) > _MAX_WORDS:
                self.reset()
            n = self.insert(word.decode())
            if len(word) <= 64:
                self.words[word] = n
        return n


def token_counts(docs: DataFrame, scores: dict[str, float]) -> DataFrame:
    """Pre-tokens and unigram tokens of every whole text.

    ``scores`` gives each piece's log probability; pre-tokens are runs of characters
    other than ASCII white space, with a mark in front. Each takes the segmentation of
    the highest total score, of these one of the fewest tokens. A character that no
    piece covers counts as a token for each of its bytes. Returns doc_id, n_pretokens,
    n_tokens, one row per input row, repeated rows included. A null or empty text has
    none. Other columns are not looked at; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scores)  # a vocabulary, some MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        count = trie.count
        for batch in batches:
            words = [x.split() for x in pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist()]
            cols = [pa.array(list(map(len, words)), pa.int64()), pa.array([sum(map(count, x)) for x in words], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "n_pretokens", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return c.map_batches(rows, run, "doc_id long, n_pretokens long, n_tokens long")
