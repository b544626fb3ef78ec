"""Quality rules judged by host.

Each document gets the counts of its words, symbols, repeated lines and
repeated windows; a document that breaks a base rule fails. Failures are summed
by host, each host's failure rate is shrunk towards all hosts' rates with a beta
prior fitted to the hosts by moments, and a host whose shrunk rate is too high
takes its documents with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Whether the key stands elsewhere too."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _own(hashes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Hashes that differ between texts."""
    return c.mix(hashes + (texts.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))


def count_rules(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The five counts of each text of a chunk."""
    word = ~c.SPACE[data]
    starts, ends = c.runs(word, offsets)
    first = c.first_of(starts, offsets)
    hashed = c.Hasher(data)
    windows, of_window = c.shingles(hashed(starts, ends), first, 3)
    at = c.window_words(first, 3)[_repeated(_own(windows, c.owner(of_window)))]
    hit = np.zeros(len(starts), bool)
    for j in range(3):
        hit[at + j] = True
    line_starts, line_ends = c.runs(data != 10, offsets)
    texts = c.owner(c.first_of(line_starts, offsets))
    words_before = np.searchsorted(starts, line_starts)
    full = np.searchsorted(starts, line_ends) > words_before
    lines, texts = hashed(line_starts[full], line_ends[full]), texts[full]
    _, kept = np.unique(_own(lines, texts), return_index=True)
    n = len(offsets) - 1
    return {
        "n_words": np.diff(first),
        "word_chars": c.per_text(word & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": c.per_text(_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(texts, minlength=n) - np.bincount(texts[kept], minlength=n),
        "n_repeat_words": c.per_text(hit, first),
    }


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in c.chunks(batch, "text"):
            counts = count_rules(data, offsets)
            kept = [x for x in part.schema.names if x != "text"]
            cols = [*(part.column(x) for x in kept), *(pa.array(counts[k].astype(np.int64)) for k in _COUNTS)]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, *_COUNTS])


def host_verdicts(docs: DataFrame, host: str, failed: Column, max_rate: float = 0.5) -> DataFrame:
    """One row per host: documents, failures, shrunk rate, and whether the host is kept.

    The prior's mean and strength come from the hosts' own rates by moments; where
    these do not vary, or vary too much for a beta distribution, its strength is 1.
    Null is a host of its own.
    """
    hosts = docs.groupBy(host).agg(F.count(F.lit(1)).alias("host_docs"), F.sum(failed.cast("long")).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    m, v = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    m, v = m or 0.0, v or 0.0
    strength = m * (1 - m) / v - 1 if 0 < v < m * (1 - m) else 1.0
    shrunk = (F.col("host_failed") + F.lit(m * strength)) / (F.col("host_docs") + F.lit(strength))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_kept", F.col("host_rate") <= max_rate)


def quality_rules(
    docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, max_host_rate: float = 0.5, key: str | None = None
) -> DataFrame:
    """Counts and verdict of every document, from doc_id, text and source.

    Returns doc_id, source, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, host_rate, kept, one row per input row. A null or
    empty text has no words and so fails; a null source is a host of its own; a
    repeated row counts each time; other columns are not looked at, but for one that
    ``key`` may name, a number that is returned too; an empty table gives an empty
    result.
    """
    more = [key] if key else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"), *(F.col(x).cast("long").alias(x) for x in more))
    schema = "doc_id long, source string, " + "".join(f"{x} long, " for x in more) + ", ".join(f"{k} long" for k in _COUNTS)
    counted = c.checkpointed(c.map_batches(rows, _measure, schema))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    counted = counted.withColumn("base_failed", failed)
    hosts = host_verdicts(counted, "source", F.col("base_failed"), max_host_rate).withColumnRenamed("source", "host")
    return counted.join(hosts, counted["source"].eqNullSafe(hosts["host"]), "left").select(
        "doc_id", "source", *more, *_COUNTS, "base_failed", "host_rate", (~F.col("base_failed") & F.col("host_kept")).alias("kept")
    )
