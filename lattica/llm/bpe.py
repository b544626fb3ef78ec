"""Exact BPE encoding by dynamic programming over prefixes.

For every prefix of a pre-token exactly one vocabulary entry can be the last
token of its encoding. An automaton over the vocabulary finds all entries that
end at a position; an entry is the last token there if it begins the pre-token
or is compatible with the last token of the prefix before it. Following the
stored tokens back from the end gives the ids.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Stands for the end of a word; byte symbols never contain it.
_END = "\n"
_MAX_CACHED = 150_000
_MAX_PAIRS = 1_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in printable:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


def unassigned() -> str:
    """A pattern for the characters that Python's Unicode tables lack."""
    out, start = [], None
    for x in range(0x80, 0x110001):
        lacking = x < 0x110000 and unicodedata.category(chr(x)) == "Cn"
        if lacking and start is None:
            start = x
        elif not lacking and start is not None:
            out.append(f"\\U{start:08x}-\\U{x - 1:08x}")
            start = None
    return "[" + "".join(out) + "]"


class Bpe:
    """A word-level BPE vocabulary: ids, merges, and what each pre-token encodes to."""

    def __init__(self, definition: str):
        whole = json.loads(definition)
        model = whole["model"]
        suffix = model["end_of_word_suffix"]
        strip = lambda t: t[: -len(suffix)] + _END if suffix and t.endswith(suffix) else t
        self.names = {i: t for t, i in model["vocab"].items()}
        ids = {strip(t): i for t, i in model["vocab"].items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b = ids[strip(a)], ids[strip(b)]
            t = ids[strip(self.names[a]) + strip(self.names[b])]
            self.rank[a, b] = k
            self.parts[t] = (a, b, k)
        self.special = {x["content"]: x["id"] for x in whole["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = whole["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        self.spaces = regex.compile(r"[\t-\r\x85\p{Z}]+")
        self.symbols = byte_symbols()
        self.right: dict[int, list[tuple[int, float]]] = {}
        self.left: dict[int, list[tuple[int, float]]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for string, i in ids.items():
            if self.reachable(i):
                self.automaton.add_word(string, (i, len(string)))
        self.automaton.make_automaton()
        self.packed = {i: i.to_bytes(4, "little") for i in self.names}
        self.cache: dict[str, tuple[bytes, str]] = {}
        self.chunks: dict[str, tuple[bytes, str]] = {}
        self.definition, self.library, self.newer = definition, None, regex.compile(unassigned())
        self.rare = re.compile(r"[^\x00-\u0377]")

    def spine(self, token: int, side: int, known: dict) -> list[tuple[int, float]]:
        """The parts of a token at its right (1) or left (0) edge, smallest last, each with the rank of the merge that takes it in."""
        if token not in known:
            out, t, rank = [], token, float("inf")
            while True:
                out.append((t, rank))
                if t not in self.parts:
                    break
                t, rank = self.parts[t][side], self.parts[t][2]
            known[token] = out
        return known[token]

    def crosses(self, a: int, b: int, below: float) -> bool:
        """Whether a merge joins parts of a and b across their border before they are whole.

        Merges of equal rank go from left to right: one inside a comes before one
        across the border, and that before one inside b.
        """
        for x, until_x in self.spine(a, 1, self.right):
            for y, until_y in self.spine(b, 0, self.left):
                rank = self.rank.get((x, y))
                if rank is not None and rank < below and rank < until_x and rank <= until_y:
                    return True
        return False

    def reachable(self, token: int) -> bool:
        """Whether the token's own string encodes to it."""
        if token not in self.parts:
            return True
        a, b, rank = self.parts[token]
        return self.reachable(a) and self.reachable(b) and not self.crosses(a, b, rank)

    def compatible(self, a: int, b: int) -> bool:
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= _MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = not self.crosses(a, b, float("inf"))
        return known

    def tokens(self, word: str) -> list[int]:
        """Ids of one pre-token, given as byte symbols."""
        n = len(word) + 1
        last: list[tuple[int, int] | None] = [None] * (n + 1)
        pairs = self.pairs
        for end, (token, length) in self.automaton.iter(word + _END):
            if last[end + 1] is None:
                start = end + 1 - length
                if start:
                    before = last[start]
                    if before is None:
                        continue
                    fits = pairs.get((before[0], token))
                    if not (self.compatible(before[0], token) if fits is None else fits):
                        continue
                last[end + 1] = (token, start)
        out, at = [], n
        while at:
            token, at = last[at]
            out.append(token)
        return out[::-1]

    def word(self, word: str) -> tuple[bytes, str]:
        """The ids as bytes, and the names of the tokens, of one pre-token."""
        found = self.cache.get(word)
        if found is None:
            ids = self.tokens(word if word.isascii() and word.isprintable() else "".join([self.symbols[b] for b in word.encode()]))
            found = b"".join([self.packed[i] for i in ids]), " ".join([self.names[i] for i in ids])
            self.keep(self.cache, word, found)
        return found

    def chunk(self, chunk: str) -> tuple[bytes, str]:
        """The same of what stands between two spaces."""
        words = self.words.findall(chunk)
        if len(words) == 1:
            found = self.word(words[0])
        else:
            pieces = [self.word(x) for x in words]
            found = b"".join([x[0] for x in pieces]), " ".join([x[1] for x in pieces])
        self.keep(self.chunks, chunk, found)
        return found

    @staticmethod
    def keep(cache: dict, key: str, value: tuple[bytes, str]) -> None:
        if len(key) <= 64:
            if len(cache) >= _MAX_CACHED:
                cache.clear()
            cache[key] = value

    def normal(self, text: str) -> str:
        """NFC, one space for each run of white space, and each character's own lower case."""
        return self.spaces.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids as bytes, and the decoded text."""
        pieces: list[tuple[bytes, str]] = []
        add, known = pieces.append, self.chunks.get
        for part in self.split.split(text) if self.split and "<|" in text else (text,):
            if part in self.special:
                add((self.packed[self.special[part]], part))
                continue
            if self.rare.search(part) and self.newer.search(part):
                pieces += [self.word(x) for x in self.split_by_library(part)]
                continue
            for chunk in self.normal(part).split(" "):
                if chunk:
                    add(known(chunk) or self.chunk(chunk))
        return b"".join([x[0] for x in pieces]), " ".join([x[1] for x in pieces])

    def split_by_library(self, text: str) -> list[str]:
        """Pre-tokens of a text with characters that Python's Unicode tables lack."""
        from tokenizers import Tokenizer, pre_tokenizers

        if self.library is None:
            self.library = Tokenizer.from_str(self.definition)
            pattern = json.loads(self.definition)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
            from tokenizers import Regex

            self.splitter = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        return [x for x, _ in self.splitter.pre_tokenize_str(self.library.normalizer.normalize_str(text))]


_LOADED: dict[str, Bpe] = {}


def load(definition: str) -> Bpe:
    """The vocabulary of a definition file's content, built once in each worker."""
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(definition)
    return _LOADED[key]


def bpe_encode(docs: DataFrame, vocabulary: str, with_ids: bool = True) -> DataFrame:
    """Every whole text as BPE ids, and decoded again.

    ``vocabulary`` is the path of a tokenizer definition (JSON) with a word-level BPE
    model. Returns doc_id, n_tokens, ids (array of int, if wanted), ids_sha256 and
    decoded_sha256, one row per input row, repeated rows included. A null or empty text
    has no ids. Other columns are not looked at; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8"))  # a few MB, by the file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(shared.value)
        for batch in batches:
            ids: list[bytes] = []
            decoded: list[str] = []
            for text in pc.fill_null(batch.column("text"), "").to_pylist():
                x = bpe.encode(text)
                ids.append(x[0])
                decoded.append(hashlib.sha256(x[1].encode()).hexdigest())
            cols = [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64())]
            if with_ids:
                cols.append(pa.array([memoryview(x).cast("i").tolist() for x in ids], pa.list_(pa.int32())))
            cols += [pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return c.map_batches(rows, run, "doc_id long, n_tokens long, " + "ids array<int>, " * with_ids + "ids_sha256 string, decoded_sha256 string")
