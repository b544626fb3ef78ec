"""Packing token sequences by repeat counts of length combinations.

Documents are cut where they fill a window, which leaves one shorter rest each. The
histogram of piece lengths, as many numbers as a window has tokens, is all that the
driver sees. Combinations of one to three lengths that fill a window exactly are
enumerated, non-negative least squares gives the number of times that each is repeated
to use the histogram up, and these numbers are rounded as far as pieces are there. What
is left is packed greedily, again by lengths. The resulting plan says which window takes
the k-th piece of a length; every task looks its own pieces up in it.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c
from .bpe import byte_symbols

#: Fixed value: the pre-token pattern that tokenizer definitions of the byte level imply.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_RANKS = 1 << 48
_STEPS = 300
#: Cut pieces that are broadcast to where their ids are; more are joined by a shuffle.
_FEW = 50_000


def encoding(definition: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizer definition (JSON), whose ids have to follow the order of its merges."""
    whole = json.loads(definition)
    model, steps = whole["model"], whole["pre_tokenizer"]
    if model["type"] != "BPE" or steps["type"] != "ByteLevel" or steps["add_prefix_space"] or whole["normalizer"]:
        raise ValueError("not a plain byte-level BPE")
    merged = [model["vocab"]["".join(x.split(" ") if isinstance(x, str) else x)] for x in model["merges"]]
    if merged != sorted(merged):
        raise ValueError("ids do not follow the merges")
    byte = {s: b for b, s in enumerate(byte_symbols())}
    special = {x["content"]: x["id"] for x in whole["added_tokens"]}
    ranks = {bytes(byte[s] for s in t): i for t, i in model["vocab"].items() if t not in special}
    return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


_LOADED: dict[str, tiktoken.Encoding] = {}


def loaded(definition: str) -> tiktoken.Encoding:
    """encoding(), built once in each worker."""
    if definition not in _LOADED:
        _LOADED.clear()
        _LOADED[definition] = encoding(definition)
    return _LOADED[definition]


def combinations(counts: np.ndarray, partners: int) -> np.ndarray:
    """Rows of three lengths, 0 for none, of at most three present lengths that sum to the window.

    All single lengths and pairs, and for each length the triples with ``partners``
    middle lengths, spread evenly over those that fit.
    """
    window = len(counts) - 1
    there = counts > 0
    lengths = np.flatnonzero(there)
    out = [np.array([[window, 0, 0]])] if there[window] else []
    low = lengths[2 * lengths <= window]
    low = low[there[window - low]]
    out.append(np.column_stack([low, window - low, np.zeros_like(low)]))
    for a in lengths[3 * lengths <= window]:
        b = lengths[(lengths >= a) & (2 * lengths <= window - a)]
        b = b[there[window - a - b]]
        if len(b) > partners:
            b = b[np.unique(np.linspace(0, len(b) - 1, partners).round().astype(int))]
        out.append(np.column_stack([np.full_like(b, a), b, window - a - b]))
    return np.concatenate(out).reshape(-1, 3)


def least_squares(combined: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Repeats x >= 0 of each combination that come nearest to the counts: accelerated projected gradients."""
    if not len(combined):
        return np.zeros(0)
    bins, goal = len(counts), counts.astype(float)
    goal[0] = 0.0
    scale = 1.0 / np.sqrt(np.maximum(goal, 1.0))
    scale[0] = 0.0
    flat = combined.ravel()

    def used(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, np.repeat(x, 3), bins)

    def back(r: np.ndarray) -> np.ndarray:
        return (scale * r)[flat].reshape(-1, 3).sum(axis=1)

    v = np.ones(len(combined))
    for _ in range(20):
        v = back(scale * used(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(combined))
    t = 1.0
    for _ in range(_STEPS):
        new = np.maximum(0.0, y - back(scale * (used(y) - goal)) / (norm * 1.05))
        following = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / following * (new - x)
        x, t = new, following
    return x


@dataclass
class Plan:
    """Where the k-th piece of a length goes; ``slots`` are sorted by length and first k.

    A slot (length, first, last, each, sequence, offset, head, tail) takes the pieces from
    first to last - 1, ``each`` of them side by side in a sequence from ``offset`` on. If
    ``head`` is not 0, only so many of a piece's ids stay there; the others are a piece
    of their own, the first of them number ``tail`` of its length.
    """

    slots: np.ndarray

    def cuts(self) -> int:
        """Pieces that a cut leaves less than whole, tails that are cut again counted anew."""
        of = self.slots[self.slots[:, 6] > 0]
        return int((of[:, 2] - of[:, 1]).sum())

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, ...]:
        """Piece number, start within the piece, length, sequence and offset of each part."""
        keys = self.slots[:, 0] * _RANKS + self.slots[:, 1]
        piece, start, out = np.arange(len(lengths)), np.zeros(len(lengths), np.int64), []
        while len(piece):
            s = self.slots[np.searchsorted(keys, lengths * _RANKS + ranks, "right") - 1]
            k = ranks - s[:, 1]
            whole = s[:, 6] == 0
            part = np.where(whole, lengths, s[:, 6])
            out.append((piece, start, part, s[:, 4] + k // s[:, 3], s[:, 5] + k % s[:, 3] * lengths))
            rest = ~whole
            piece, start, lengths, ranks = piece[rest], (start + part)[rest], (lengths - part)[rest], (s[:, 7] + k)[rest]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(5))


class _Planner:
    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        self.left[0] = 0
        self.taken = np.zeros(len(counts), np.int64)
        self.known = self.left.copy()
        self.slots: list[tuple[int, ...]] = []
        self.sequences = 0

    def take(self, length: int, n: int, each: int, offset: int, head: int = 0) -> None:
        first = int(self.taken[length])
        self.taken[length] += n * each
        self.left[length] -= n * each
        tail = 0
        if head:
            tail = int(self.known[length - head])
            self.known[length - head] += n
            self.left[length - head] += n
        self.slots.append((length, first, first + n * each, each, self.sequences, offset, head, tail))

    def repeat(self, lengths: list[int], n: int) -> None:
        """A whole combination, n times."""
        offset = 0
        for length, each in sorted(Counter(lengths).items(), reverse=True):
            self.take(length, n, each, offset)
            offset += length * each
        self.sequences += n

    def fill(self, window: int, slack: int) -> None:
        """One greedy pattern as often as it can be repeated: the longest pieces that fit, and the head of another if much room is left."""
        room, parts = window, []
        while room:
            below = min(room + 1, parts[-1][0]) if parts else room + 1
            fits = np.flatnonzero(self.left[:below])
            if not len(fits):
                break
            length = int(fits[-1])
            each = min(room // length, int(self.left[length]))
            parts.append((length, each))
            room -= length * each
        n = min((int(self.left[x]) // each for x, each in parts), default=1 << 62)
        cut, held = 0, dict(parts)
        if room > slack:
            longer = np.flatnonzero(self.left[room + 1 :])[::-1] + room + 1
            cut = next((int(x) for x in longer if self.left[x] > held.get(int(x), 0)), 0)
            if cut:
                n = min(n, int(self.left[cut]) // (1 + held.get(cut, 0)))
        if window < len(self.left) - 1:
            n = 1
        offset = 0
        for length, each in parts:
            self.take(length, n, each, offset)
            offset += length * each
        if cut:
            self.take(cut, n, 1, offset, room)
        self.sequences += n


def plan(counts: np.ndarray, slack: int, partners: int) -> Plan:
    """Windows for pieces of which ``counts`` says how many there are of each length, from 0 to the window."""
    window = len(counts) - 1
    made = _Planner(counts)
    combined = combinations(counts, partners)
    repeats = least_squares(combined, counts)
    for k in np.argsort(-repeats, kind="stable"):
        if repeats[k] <= 1e-6:
            break
        lengths = [int(x) for x in combined[k] if x]
        there = min(int(made.left[x]) // n for x, n in Counter(lengths).items())
        if n := min(int(np.ceil(repeats[k])), there):
            made.repeat(lengths, n)
    lengths = np.arange(window + 1)
    while left := int(made.left @ lengths):
        # the last tokens, too few for a window, go to sequences of powers of two
        made.fill(window if left >= window else 1 << (left.bit_length() - 1), slack if left >= window else 0)
    slots = np.array(made.slots, np.int64).reshape(-1, 8)
    return Plan(slots[np.lexsort((slots[:, 1], slots[:, 0]))])


def tokenised(docs: DataFrame, definition: str, window: int, end: int) -> DataFrame:
    """Pieces of all texts: doc_id, start, length, crc, doc_tokens, ids (bytes), and task and k, which number a task's pieces of a length."""
    shared = docs.sparkSession.sparkContext.broadcast(definition)  # some MB, by the file
    wide = max(loaded(definition).n_vocab, end + 1) > 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = loaded(shared.value), TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [], [])
            for row, text in enumerate(pc.fill_null(batch.column("text"), "").to_pylist()):
                ids = np.append(coder.encode_to_numpy(text, allowed_special="all"), np.uint32(end)).astype("<u4")
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    n = len(part)
                    for col, x in zip(cols, (row, start, n, zlib.crc32(part.tobytes()), len(ids), part.astype("<u4" if wide else "<u2").tobytes(), seen[n]), strict=True):
                        col.append(x)
                    seen[n] += 1
            at = pa.array(cols[0], pa.int64())
            rest = [pa.array(x, t) for x, t in zip(cols[1:], (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), *rest, pa.array([task] * len(at), pa.int64())], names=["doc_id", "start", "length", "crc", "doc_tokens", "ids", "k", "task"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return c.map_batches(rows, run, "doc_id long, start long, length long, crc long, doc_tokens long, ids binary, k long, task long")


def placed(pieces: DataFrame, found: Plan) -> DataFrame:
    """Parts of pieces with their sequence and offset; ``rank`` is a piece's number among all of its length."""
    shared = pieces.sparkSession.sparkContext.broadcast(found)  # some slots a combination, by the window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            piece, start, length, sequence, offset = shared.value.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            old = batch.take(pa.array(piece))
            cols = [old.column(x) for x in ("doc_id", "start", "crc", "doc_tokens", "task", "length", "k")]
            yield pa.RecordBatch.from_arrays(
                [*cols, *(pa.array(x, pa.int64()) for x in (start, length, sequence, offset))],
                names=["doc_id", "start", "crc", "doc_tokens", "task", "piece", "k", "within", "length", "sequence_id", "offset"],
            )

    kind = "doc_id long, start long, crc long, doc_tokens long, task long, piece long, k long, within long, length long, sequence_id long, offset long"
    return pieces.mapInArrow(run, kind)


def cut(parts: DataFrame, size: int) -> DataFrame:
    """Each part's own ids, as bytes of 32-bit integers, and their CRC, out of its piece's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, crcs = [], []
            for x, at, n in zip(batch.column("ids").to_pylist(), batch.column("within").to_pylist(), batch.column("length").to_pylist(), strict=True):
                part = np.frombuffer(x, f"<u{size}")[at : at + n].astype("<u4").tobytes()
                ids.append(part)
                crcs.append(zlib.crc32(part))
            kept = batch.drop_columns(["ids", "crc"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(ids, pa.binary()), pa.array(crcs, pa.int64())], names=[*kept.schema.names, "ids", "crc"])

    kind = parts.drop("ids", "crc").schema.add("ids", "binary").add("crc", "long")
    return c.map_batches(parts, run, kind)


def pack(docs: DataFrame, vocabulary: str, window: int = 2048, end: int = 1, slack: int = 20, partners: int = 16, with_ids: bool = False) -> DataFrame:
    """All documents as pieces of sequences of ``window`` tokens.

    ``vocabulary`` is the path of a tokenizer definition (JSON) of a byte-level BPE; a
    document's ids are those of its whole text and ``end``. A sequence is filled but for
    ``slack`` tokens at most; only the last tokens, fewer than a window, go to sequences
    of powers of two, which need no padding. Documents longer than a window are cut at
    its multiples, and a rest where otherwise more than ``slack`` tokens would stay empty.

    Returns a row a piece: doc_id, start (ids of its document before it), length,
    ids_crc32, doc_tokens, sequence_id (from 0 without gaps), offset, and, if wanted, ids
    (bytes of little-endian 32-bit integers). A null or empty text is ``end`` alone.
    Repeated rows are packed each for itself, and so are rows without a doc_id. Other
    columns are not looked at; an empty table gives an empty result.
    """
    definition = Path(vocabulary).read_text(encoding="utf-8")
    pieces = c.stored(tokenised(docs, definition, window, end))
    size = 4 if max(loaded(definition).n_vocab, end + 1) > 1 << 16 else 2
    counted = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    by_length = counted.groupBy("length").agg(F.sum("n").alias("n")).toArrow()  # at most a row for each length
    counts = np.zeros(window + 1, np.int64)
    counts[by_length["length"].to_numpy()] = by_length["n"].to_numpy()
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counted.select("task", "length", before.alias("before"))
    numbered = pieces.drop("ids").join(starts, ["task", "length"]).withColumn("rank", F.col("before") + F.col("k"))
    found = plan(counts, slack, partners)
    parts = c.stored(placed(numbered, found))
    whole = F.col("length") == F.col("piece")
    stays = F.lit(False) if with_ids else whole
    names = ["doc_id", (F.col("start") + F.col("within")).alias("start"), "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"]
    keys = pieces.select("task", F.col("length").alias("piece"), "k", "ids")
    less = parts.where(~stays)
    few = not with_ids and 2 * found.cuts() <= _FEW
    others = cut((F.broadcast(less) if few else less).join(keys, ["task", "piece", "k"]), size)
    if with_ids:
        return others.select(*names, "ids")
    return parts.where(stays).select(*names).unionByName(others.select(*names))
