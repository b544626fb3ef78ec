"""Fill-in-the-middle texts, cut by rank and select on packed bits.

The bytes of many texts lie in one array. One bit for each byte says whether a token
ends there; the bits are packed in words of 64, and a directory holds the number of
set bits before each block of words. The set bits within a text are its number of
tokens, and the places of two of them, found by select, are its two cuts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_WORDS = 8


class Bits:
    """Set bits of a long vector: how many come before a place, and where the k-th one is."""

    def __init__(self, flags: np.ndarray):
        size = -(-max(len(flags), 1) // (64 * _WORDS)) * _WORDS * 8
        packed = np.zeros(size, np.uint8)
        bits = np.packbits(flags, bitorder="little")
        packed[: len(bits)] = bits
        self.words = packed.view("<u8")
        counts = np.bitwise_count(self.words).reshape(-1, _WORDS).sum(axis=1, dtype=np.int64)
        self.directory = np.concatenate([[0], np.cumsum(counts)])

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word = places >> 6
        block = word // _WORDS
        out = self.directory[block].copy()
        last = len(self.words) - 1
        for k in range(_WORDS):
            at = block * _WORDS + k
            inside = at < word
            out += np.where(inside, np.bitwise_count(self.words[np.minimum(at, last)]), 0)
        part = self.words[np.minimum(word, last)] & ((np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1))
        return out + np.bitwise_count(part)

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """Place of the set bit that has so many before it."""
        block = np.searchsorted(self.directory, ranks, "right") - 1
        left = ranks - self.directory[block]
        word = block * _WORDS
        found = np.zeros(len(ranks), bool)
        for _ in range(_WORDS - 1):
            n = np.bitwise_count(self.words[word]).astype(np.int64)
            found |= left < n
            left = np.where(found, left, left - n)
            word = np.where(found, word, word + 1)
        rest, place = self.words[word], word * 64
        for width in (32, 16, 8, 4, 2, 1):
            low = rest & np.uint64((1 << width) - 1)
            n = np.bitwise_count(low).astype(np.int64)
            above = left >= n
            left = np.where(above, left - n, left)
            rest = np.where(above, rest >> np.uint64(width), low)
            place = place + np.where(above, width, 0)
        return place


def token_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Flags of the bytes that end a token: the last byte of a word, and that of a text."""
    n = len(data)
    word = ~c.SPACE[data]
    ends = np.zeros(n, bool)
    ends[:-1] = word[:-1] & ~word[1:]
    full = offsets[1:] > offsets[:-1]
    ends[offsets[1:][full] - 1] = True
    return ends


def has_marker(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text contains one of the three markers."""
    if len(data) < 3:
        return np.zeros(len(offsets) - 1, bool)
    middle = np.zeros(256, bool)
    middle[list(b"PSM")] = True
    at = np.flatnonzero((data[:-2] == 60) & middle[data[1:-1]] & (data[2:] == 62))
    text = np.searchsorted(offsets, at, "right") - 1
    out = np.zeros(len(offsets) - 1, bool)
    out[text[at + 3 <= offsets[text + 1]]] = True
    return out


def draws(ids: list[int | None], seed: int) -> np.ndarray:
    """Four numbers of 32 bits for each id; a missing id counts as an empty text."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest() for i in ids)
    return np.frombuffer(digests, ">u4").reshape(-1, 8)[:, :4].astype(np.int64)


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, suffix_first: int = 80) -> DataFrame:
    """Every whole text with its middle moved to the end, or as it is.

    A text is cut into tokens, each a word with the white space before it; white space
    at the end is one token. Two ranks drawn from ``seed`` and doc_id give prefix,
    middle and suffix. Of all documents ``percent`` in a hundred are transformed, of
    these ``suffix_first`` in a hundred begin with the suffix (form spm), others with the
    prefix (psm). Empty texts and those that contain a marker stay plain.

    Returns doc_id, n (tokens), form, prefix_chars and middle_chars (code points, null if
    plain) and output, one row per input row. A null text is empty; a null doc_id draws
    by the empty string, so rows alike in id are cut by the same draws. Other columns are
    not looked at; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in c.chunks(batch, "text"):
                ends = Bits(token_ends(data, offsets))
                letters = Bits((data & 0xC0) != 0x80)
                before = ends.rank(offsets)
                n = np.diff(before)
                h = draws(rows.column("doc_id").to_pylist(), seed)
                units = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
                plain = (n == 0) | has_marker(data, offsets) | (h[:, 2] % 100 >= percent)
                spm = h[:, 3] % 100 < suffix_first
                cuts = np.repeat(offsets[:-1, None], 2, axis=1)
                inner = units > 0
                cuts[inner] = ends.select((before[:-1, None] + units - 1)[inner]) + 1
                chars = np.diff(letters.rank(np.column_stack([offsets[:-1], cuts]).ravel()).reshape(-1, 3), axis=1)
                body, outputs = data.tobytes(), []
                for k in range(len(n)):
                    start, a, b, end = offsets[k], cuts[k, 0], cuts[k, 1], offsets[k + 1]
                    if plain[k]:
                        outputs.append(body[start:end])
                    elif spm[k]:
                        outputs.append(b"<S>" + body[b:end] + b"<P>" + body[start:a] + b"<M>" + body[a:b])
                    else:
                        outputs.append(b"<P>" + body[start:a] + b"<S>" + body[b:end] + b"<M>" + body[a:b])
                form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), pa.array(chars[:, 0], pa.int64(), mask=plain),
                     pa.array(chars[:, 1], pa.int64(), mask=plain), pa.array(outputs, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return c.map_batches(rows, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(formed: DataFrame) -> DataFrame:
    """Adds restored: the text that ``output`` was made of, put together again by form.

    A transformed text holds no marker of its own, and none can arise where its parts
    meet the markers, so that the three markers split the output.
    """
    parts = F.split("output", "|".join((PREFIX, SUFFIX, MIDDLE)))
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return formed.withColumn("restored", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("output")))
