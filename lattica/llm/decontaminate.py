"""Benchmark decontamination by Wu-Manber search over words.

The strings searched for are all windows of 13 words of the benchmark's items.
A shift table tells from the last words of a window position how far the next
possible match lies, so that most positions are never looked at; where the shift
is zero, the bucket of that suffix is compared directly.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common as c

#: Lower case for A-Z, and a space for each ASCII character that is no letter or digit.
_WORDS = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x > 127 else 32 for x in range(256))
_FOUND = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
_VERDICT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
#: The block that this worker has searched with last, by name, and its tables.
_held: dict[str, Searcher] = {}


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Searcher:
    """Shift tables and buckets, one pair for each length of string."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = 13, block: int = 3):
        strings: dict[int, dict[tuple, set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            words = words_of(text)
            m = min(window, len(words))
            for i in range(len(words) - m + 1 if m else 0):
                strings[m][tuple(words[i : i + m])].add(item)
        self.tables = []
        for m, found in sorted(strings.items()):
            b = min(block, m)
            shift: dict[tuple, int] = {}
            buckets: dict[tuple, dict[tuple, set[str]]] = defaultdict(dict)
            for string, owners in found.items():
                for end in range(b, m + 1):
                    key = string[end - b : end]
                    shift[key] = min(shift.get(key, m), m - end)
                buckets[string[m - b :]][string] = owners
            self.tables.append((m, b, shift, dict(buckets)))

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words inside occurrences, and the items that occur."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        n = len(words)
        for m, b, shift, buckets in self.tables:
            far, end = m - b + 1, m
            while end <= n:
                key = tuple(words[end - b : end])
                skip = shift.get(key, far)
                if skip:
                    end += skip
                    continue
                if owners := buckets[key].get(tuple(words[end - m : end])):
                    spans.append((end - m, end))
                    items |= owners
                end += 1
        return spans, items


def covered(spans: list[tuple[int, int]]) -> int:
    total, reach = 0, 0
    for start, end in sorted(spans):
        total += max(0, end - max(start, reach))
        reach = max(reach, end)
    return total


def searcher_of(name: str, items: list[tuple[str, bytes]], window: int) -> Searcher:
    """The tables of a block, built once in a worker, which holds those of one block only."""
    if name not in _held:
        _held.clear()
        _held[name] = Searcher(items, window)
    return _held[name]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist()


def _verdict(words: list[bytes], spans: list[tuple[int, int]], items: set[str], percent: int) -> tuple:
    names, n, hit = sorted(items), len(words), covered(spans)
    return n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0 and 100 * hit >= percent * n


def _judged(batch: pa.RecordBatch, out: list[tuple], left: tuple[str, ...], name: str) -> pa.RecordBatch:
    """The batch without some columns, and with verdicts as one struct column."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    found = pa.StructArray.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=list(_FOUND))
    kept = [x for x in batch.schema.names if x not in left]
    return pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), found], names=[*kept, name])


def _whole(name: str, shared, window: int, percent: int, column: str):
    """Verdicts where the benchmark is one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = searcher_of(name, shared.value, window)
        for batch in batches:
            texts = [words_of(x) for x in _texts(batch)]
            yield _judged(batch, [_verdict(x, *searcher.search(x), percent) for x in texts], (), column)

    return run


def _hits(name: str, shared, window: int):
    """Spans and items of one block, of the texts that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = searcher_of(name, shared.value, window)
        for batch in batches:
            found = [searcher.search(words_of(x)) for x in _texts(batch)]
            take = [i for i, x in enumerate(found) if x[0]]
            spans = pa.array([[list(y) for y in found[i][0]] for i in take], pa.list_(pa.list_(pa.int32())))
            items = pa.array([sorted(found[i][1]) for i in take], pa.list_(pa.string()))
            keys = [batch.column(x).take(pa.array(take, pa.int64())) for x in ("t1", "t2")]
            yield pa.RecordBatch.from_arrays([*keys, spans, items], names=["t1", "t2", "spans", "items"])

    return run


def _summed(percent: int, spans: str, items: str, column: str):
    """Verdicts from the hits of all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(_texts(batch), batch.column(spans).to_pylist(), batch.column(items).to_pylist(), strict=True)
            out = [_verdict(words_of(t), [(a, b) for a, b in x or ()], set(y or ()), percent) for t, x, y in rows]
            yield _judged(batch, out, (spans, items), column)

    return run


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark in blocks of about ``block_bytes``, each read when it is asked for."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    for k in range(n):
        yield [(r["item"] or "", r["text"].encode()) for r in dealt.where(F.col("block") == k).collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 5, block_bytes: int = 8 << 20) -> DataFrame:
    """Benchmark passages in every document.

    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated, one row per
    input row. A null or empty text has no words and is clean; repeated rows fare
    alike; an empty table of documents gives an empty result. Items without words
    are never found; equal items are all named; an item of fewer words than the
    window is searched for as a whole. An empty benchmark leaves all clean. Other
    columns are not looked at. A benchmark larger than ``block_bytes`` is searched
    for block after block: driver and workers hold one block at a time, what it hits
    is stored, and at last joined with the documents.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found, name = search(rows, benchmark, window, percent, block_bytes)
    return found.select("doc_id", *(f"{name}.{x}" for x in _FOUND))


def search(docs: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 5, block_bytes: int = 8 << 20) -> tuple[DataFrame, str]:
    """All columns of the documents and what decontaminate() finds as a struct.

    Also returns the struct's name, which no column of the documents has.
    """
    sc = docs.sparkSession.sparkContext
    column, t1, t2, spans, items = c.fresh(docs, "found", "t1", "t2", "spans", "items")
    schema = StructType([docs.schema[x] for x in docs.columns]).add(column, StructType.fromDDL(_VERDICT))
    blocks = item_blocks(benchmark, block_bytes)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return c.map_batches(docs, _whole(uuid.uuid4().hex, sc.broadcast(first), window, percent, column), schema), column
    key1, key2 = F.xxhash64("text"), F.xxhash64(F.lit("text"), "text")
    texts = docs.select(key1.alias("t1"), key2.alias("t2"), "text")
    stored = []
    block: list | None = first
    while block is not None:
        shared = sc.broadcast(block)
        kind = "t1 long, t2 long, spans array<array<int>>, items array<string>"
        stored.append(c.stored(c.map_batches(texts, _hits(uuid.uuid4().hex, shared, window), kind)))
        shared.destroy()
        block, second = second, None
        if block is None:
            block = next(blocks, None)
    hits = stored[0]
    for more in stored[1:]:
        hits = hits.unionByName(more)
    joined = F.flatten(F.collect_set("spans")).alias(spans), F.flatten(F.collect_set("items")).alias(items)
    hits = hits.groupBy(F.col("t1").alias(t1), F.col("t2").alias(t2)).agg(*joined)
    rows = docs.withColumns({t1: key1, t2: key2}).join(hits, [t1, t2], "left").select(*docs.columns, spans, items)
    return c.map_batches(rows, _summed(percent, spans, items, column), schema), column
