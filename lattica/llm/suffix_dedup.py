"""Removal of every byte inside a long string that also stands elsewhere.

Sorting all suffixes brings equal strings together, but nearly all suffixes of a
corpus share no long prefix with any other. They are told apart beforehand:

1. Every window of 200 bytes contains an anchor, the start of its least hashed
   48-gram; equal windows have it at the same place. The windows that share an
   anchor are its scope. Scopes are counted by fingerprint. A scope found twice is
   repeated as a whole; a core whose scopes differ is contested.
2. In contested scopes windows are counted by fingerprint, and runs of repeated
   windows that have the same partners become suffixes to sort.
3. These suffixes are sorted in runs, front-coded, dealt out by splitters and merged
   by loser trees that keep the common prefix with the last output, so that no known
   prefix is compared again. The common prefix with a neighbour is what is removed.

Fingerprints of scopes have 128 bits.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Bytes of an anchor's gram, and the share of a window that it takes at most.
_CORE, _SHARE = 48, 4
#: Scopes and blocks of a batch are numbered together in steps of this; no window has as many bytes.
_STEP = 1 << 20
_RUN_BYTES = 16 << 20
_BUCKET_BYTES = 8 << 20
_PREFIX = 64
#: Windows of a scope that are looked at together at first.
_BLOCK = 8
#: Place of the one scope that stands for a repeated one; no span comes from it.
_ELSEWHERE = -(1 << 60)


def core_of(size: int) -> int:
    return min(_CORE, size // _SHARE)


def anchors(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Text number, anchor, first and last window of every scope of a chunk, and a hasher."""
    core = core_of(size)
    hashed = c.Hasher(data)
    n, w = len(data), size - core + 1
    none = np.zeros(0, np.int64)
    if n < size:
        return none, none, none, none, hashed
    at = np.arange(n - core + 1)
    bits = np.uint64(max(21, int(n).bit_length()))
    value = (hashed(at, at + core) >> bits << bits) | at.astype(np.uint64)
    blocks = -(-len(value) // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(value)] = value
    padded = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - size + 1
    least = np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows]) & ((np.uint64(1) << bits) - np.uint64(1))
    ends = offsets[1:]
    text = np.searchsorted(ends, np.arange(windows), "right")
    inside = np.flatnonzero(np.arange(windows) + size <= ends[np.minimum(text, len(ends) - 1)])
    if not len(inside):
        return none, none, none, none, hashed
    chosen, text = least[inside].astype(np.int64), text[inside]
    new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])])
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(inside)) - 1
    return text[start], chosen[start], inside[start], inside[stop], hashed


def _scopes(data: np.ndarray, offsets: np.ndarray, size: int):
    text, anchor, first, last, hashed = anchors(data, offsets, size)
    end = last + size
    core = hashed(anchor, anchor + core_of(size))
    shape = ((anchor - first) * _STEP + (end - first)).astype(np.uint64)
    s1 = c.mix(hashed(first, end) ^ c.mix(shape))
    middle = (first + end) // 2
    s2 = c.mix(hashed(first, middle) + np.uint64(3) * hashed(middle, end)) ^ core
    return text, anchor, first, end, core, s1, s2


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in c.chunks(batch, "text"):
                text, *_, core, s1, s2 = _scopes(data, offsets, size)
                rk = part.column("rk").to_numpy()[text]
                yield pa.RecordBatch.from_arrays([_long(core), _long(s1), _long(s2), pa.array(rk)], names=["core", "s1", "s2", "rk"])

    return run


def _candidates(size: int, settled, contested, chosen):
    """Scopes that may be repeated; where they may be contested, each one's bytes, once of those that are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, part_of, picked = settled.value, contested.value, chosen.value
        for batch in batches:
            for part, data, offsets in c.chunks(batch, "text"):
                text, anchor, first, end, core, s1, s2 = _scopes(data, offsets, size)
                open_, many = part_of(core), whole(s1)
                open_ &= picked(s1 ^ part.column("rk").to_numpy()[text].view(np.uint64))
                take = np.flatnonzero(open_ | many)
                rk = part.column("rk").to_numpy()[text[take]]
                base = offsets[text[take]]
                body = [data[a:b].tobytes() if o else None for a, b, o in zip(first[take], end[take], open_[take], strict=True)]
                cols = [pa.array(rk), _long(anchor[take] - base), _long(first[take] - base), _long(end[take] - base), _long(core[take]), _long(s1[take]), _long(s2[take]), pa.array(body, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["rk", "anchor", "first", "end", "core", "s1", "s2", "body"])

    return run


def _blocks(size: int, passed=None):
    """A fingerprint for each block of contested windows, of what its windows have in common.

    Blocks are counted from the anchor. Where that string is found once, no window of
    the block is repeated. A filter lets only some fingerprints through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, at, hashed, rel = _laid_out(batch, size, None)
            block = (rel[which] - at[1]) // _BLOCK
            one = np.unique(which * _STEP + block + _STEP // 2)
            which, block = one // _STEP, one % _STEP - _STEP // 2
            start = at[2][which] + rel[which] - _BLOCK * block
            fp = c.mix(hashed(start, start - _BLOCK + 1 + size) ^ (block + 1).astype(np.uint64))
            yield _passing(fp, batch, which, block, "block", passed)

    return run


def _windows(size: int, passed=None):
    """A fingerprint for each contested window of the blocks that may have repeated ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, at, hashed, _ = _laid_out(batch, size, batch.column("blocks").to_pylist())
            yield _passing(hashed(at[0], at[0] + size), batch, which, at[1], "at", passed)

    return run


def _passing(fp: np.ndarray, batch: pa.RecordBatch, which: np.ndarray, at: np.ndarray, name: str, passed) -> pa.RecordBatch:
    """Fingerprints with their scope and place, of those that a filter lets through."""
    if passed is not None:
        take = passed.value(fp)
        fp, which, at = fp[take], which[take], at[take]
    return pa.RecordBatch.from_arrays([_long(fp), pa.array(batch.column("mid").to_numpy()[which]), _long(at)], names=["fp", "mid", name])


def _laid_out(batch: pa.RecordBatch, size: int, blocks: list[list[int]] | None):
    """The windows of the batch's scopes: number of the scope, places (in all bytes, in the scope, of the scope), hasher, anchors."""
    bodies = batch.column("body").to_pylist()
    lengths = np.array([len(x) for x in bodies], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    rel = batch.column("rel").to_numpy()
    counts = lengths - size + 1
    which = np.repeat(np.arange(len(bodies)), counts)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    if blocks is not None:
        wanted = np.concatenate([np.array(x, np.int64) + _STEP * i for i, x in enumerate(blocks)])
        keep = np.isin(which * _STEP + (rel[which] - inner) // _BLOCK, wanted)
        which, inner = which[keep], inner[keep]
    return which, (offsets[which] + inner, inner, offsets), c.Hasher(np.frombuffer(b"".join(bodies), np.uint8)), rel


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    step = 16
    while a[known : known + step] == b[known : known + step]:
        known += step
        step *= 2
    low, high = known, known + step
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def front_code(sorted_strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Common prefixes with the string before, and what follows them."""
    shared = [0, *(common_prefix(a, b) for a, b in zip(sorted_strings, sorted_strings[1:], strict=False))]
    return shared, [x[n:] for x, n in zip(sorted_strings, shared, strict=True)]


def merge_runs(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, bytes, int]]:
    """The strings of front-coded sorted runs in order: common prefix with the one before, string, run.

    A loser tree: each run's head knows its common prefix with the last output. The
    longer one wins unseen; only heads with equal ones are compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[tuple[bytes, int] | None] = [None] * k
    shared = [0] * k

    def advance(r: int, before: bytes) -> None:
        following = next(runs[r], None) if r < len(runs) else None
        if following is None:
            heads[r] = None
        else:
            shared[r] = following[0]
            heads[r] = (before[: following[0]] + following[1], r)

    def winner(x: int, y: int) -> tuple[int, int]:
        if heads[x] is None:
            return y, x
        if heads[y] is None or shared[x] > shared[y]:
            return x, y
        if shared[x] < shared[y]:
            return y, x
        a, b, h = heads[x][0], heads[y][0], shared[x]
        h = common_prefix(a, b, h)
        if a[h:] <= b[h:]:
            shared[y] = h
            return x, y
        shared[x] = h
        return y, x

    for r in range(k):
        advance(r, b"")
    losers = [0] * k
    level = list(range(k))
    at = k // 2
    while len(level) > 1:
        nxt = []
        for i in range(0, len(level), 2):
            won, losers[at + i // 2] = winner(level[i], level[i + 1])
            nxt.append(won)
        level, at = nxt, at // 2
    top = level[0]
    while heads[top] is not None:
        string = heads[top][0]
        yield shared[top], string, top
        advance(top, string)
        node = (top + k) // 2
        while node:
            top, losers[node] = winner(top, losers[node])
            node //= 2


def place_mask(size: int) -> int:
    """Low bits that hold any place of a window in its scope; the others are left to a hash."""
    return (1 << size.bit_length()) - 1


def _sorted_runs(size: int, splitters: list[bytes]):
    """Suffixes of runs of windows with the same partners, sorted and front-coded by bucket.

    Rows with a bucket are runs; the others say which suffixes an entry stands for.
    """

    def flush(held: list[tuple[bytes, int, int]], run_id: int) -> Iterator[dict]:
        held.sort()
        strings: list[bytes] = []
        many: list[bool] = []
        members: list[tuple[int, int, int]] = []
        for string, rk, start in held:
            if strings and strings[-1] == string:
                many[-1] = True
            else:
                strings.append(string)
                many.append(False)
            members.append((len(strings) - 1, rk, start))
        for entry, rk, start in members:
            yield {"bucket": None, "run": run_id, "entry": entry, "rk": rk, "start": start, "lcps": None, "sizes": None, "tails": None, "many": None}
        at = 0
        while at < len(strings):
            bucket = bisect_right(splitters, strings[at][:_PREFIX])
            to = at + 1
            while to < len(strings) and (bucket == len(splitters) or strings[to][:_PREFIX] < splitters[bucket]):
                to += 1
            shared, tails = front_code(strings[at:to])
            yield {
                "bucket": bucket, "run": run_id, "entry": at, "rk": None, "start": None,
                "lcps": np.array(shared, np.int32).tobytes(), "sizes": np.array([len(x) for x in tails], np.int32).tobytes(), "tails": b"".join(tails), "many": bytes(many[at:to]),
            }
            at = to

    mask = place_mask(size)
    schema = pa.schema([("bucket", pa.int32()), ("run", pa.int64()), ("entry", pa.int32()), ("rk", pa.int64()), ("start", pa.int64()), ("lcps", pa.binary()), ("sizes", pa.binary()), ("tails", pa.binary()), ("many", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, int]] = []
        total, run_id = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for rk, first, body, repeated in zip(*(batch.column(x).to_pylist() for x in ("rk", "first", "body", "repeated")), strict=True):
                places = sorted((x & mask, x & ~mask) for x in repeated)
                begun = 0
                for i in range(1, len(places) + 1):
                    if i == len(places) or places[i][0] != places[i - 1][0] + 1 or places[i][1] != places[i - 1][1]:
                        start, end = places[begun][0], places[i - 1][0] + size
                        held.append((body[start:end], rk, first + start))
                        total += end - start
                        begun = i
            if total > _RUN_BYTES:
                yield pa.RecordBatch.from_pylist(list(flush(held, run_id)), schema)
                held, total, run_id = [], 0, run_id + 1
        if held:
            yield pa.RecordBatch.from_pylist(list(flush(held, run_id)), schema)

    return run


def _decoded(lcps: bytes, sizes: bytes, tails: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    for shared, n in zip(np.frombuffer(lcps, np.int32).tolist(), np.frombuffer(sizes, np.int32).tolist(), strict=True):
        yield shared, tails[at : at + n]
        at += n


def _merged(size: int):
    """What of each entry also stands at its neighbours in the order of all suffixes."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        runs = [_decoded(*x) for x in zip(rows["lcps"], rows["sizes"], rows["tails"], strict=True)]
        ids, entries, many = rows["run"].tolist(), rows["entry"].tolist(), rows["many"].tolist()
        done = [0] * len(runs)
        last: tuple[int, int, int] | None = None
        for shared, string, r in merge_runs(runs):
            if last is not None:
                out.append((last[0], last[1], max(last[2], shared)))
            known = len(string) if many[r][done[r]] else 0
            last = (ids[r], entries[r] + done[r], max(shared, known))
            done[r] += 1
        if last is not None:
            out.append(last)
        return pd.DataFrame([x for x in out if x[2] >= size], columns=["run", "entry", "length"]).astype({"run": "int64", "entry": "int32", "length": "int64"})

    return run


def _contested_spans(members: DataFrame, size: int) -> DataFrame:
    def shared(rows: DataFrame, make, kind: str) -> DataFrame:
        """Fingerprints found twice, with a number for who has them; counted before any is dealt out."""
        counted = c.map_batches(rows, make(size), kind).groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("mid")).alias("sig"))
        counted = c.checkpointed(counted.where("n > 1").select("fp", "sig"))
        passed = rows.sparkSession.sparkContext.broadcast(c.KeyFilter(counted, "fp"))
        return c.map_batches(rows, make(size, passed), kind).join(counted, "fp")

    blocks = shared(members.select("mid", "rel", "body"), _blocks, "fp long, mid long, block long")
    blocks = blocks.groupBy("mid").agg(F.collect_list(F.col("block").cast("int")).alias("blocks"))
    members = c.checkpointed(members.join(blocks, "mid"))
    windows = shared(members.select("mid", "rel", "body", "blocks"), _windows, "fp long, mid long, at long")
    repeated = windows.groupBy("mid").agg(F.collect_list(F.expr(f"sig & ~{place_mask(size)}L | at")).alias("repeated"))
    ready = members.join(repeated, "mid").select("rk", "first", "body", "repeated")
    total = members.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    buckets = max(1, total // _BUCKET_BYTES)
    sample = members.select("mid", F.expr(f"substring(body, 1 + cast(pmod(mid, length(body) - {size} + 1) as int), {_PREFIX})").alias("s")).orderBy("mid").limit(min(20 * buckets, 100_000))
    drawn = sorted({bytes(r["s"]) for r in sample.collect()})
    splitters = drawn[:: max(1, len(drawn) // buckets)][1:]
    kind = "bucket int, run long, entry int, rk long, start long, lcps binary, sizes binary, tails binary, many binary"
    runs = c.checkpointed(c.map_batches(ready, _sorted_runs(size, splitters), kind))
    found = runs.where("bucket is not null").groupBy("bucket").applyInPandas(_merged(size), "run long, entry int, length long")
    return runs.where("bucket is null").select("run", "entry", "rk", "start").join(found, ["run", "entry"]).select("rk", "start", (F.col("start") + F.col("length")).alias("end"))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        texts = pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist()
        for text, spans in zip(texts, batch.column("spans").to_pylist(), strict=True):
            kept, removed, n_spans, reach = hashlib.sha256(), 0, 0, 0
            pieces, cut = [], None
            for start, end in sorted((x["start"], x["end"]) for x in spans or ()):
                if cut is None or start > cut:
                    pieces.append(text[reach:start])
                    n_spans += 1
                    cut = start
                    reach = start
                if end > cut:
                    removed += end - max(start, cut)
                    cut = reach = end
            pieces.append(text[reach:])
            whole = b"".join(pieces)
            kept.update(whole)
            out.append((len(text), removed, n_spans, kept.hexdigest(), whole))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        cols = [pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _join_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple[int, int, int]] = []
        for rk, spans in zip(batch.column("rk").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            for start, end in sorted((x["start"], x["end"]) for x in spans):
                if out and out[-1][0] == rk and start <= out[-1][2]:
                    out[-1] = (rk, out[-1][1], max(end, out[-1][2]))
                else:
                    out.append((rk, start, end))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=["rk", "start", "end"])


def _live(rows: DataFrame, size: int) -> DataFrame:
    """Scopes that are repeated or share a core with another scope."""
    counted = c.checkpointed(
        c.map_batches(rows, _fingerprints(size), "core long, s1 long, s2 long, rk long")
        .groupBy("core", "s1", "s2")
        .agg(F.count(F.lit(1)).alias("n"), F.min("rk").alias("low"))
    )
    cores = counted.groupBy("core").agg(F.count(F.lit(1)).alias("scopes"), F.min("n").alias("least"), F.max("n").alias("most")).where("scopes > 1 or most > 1")
    return c.checkpointed(counted.join(cores, "core").select("core", "s1", "s2", "n", "low", F.expr("scopes > 1 and least = 1").alias("contested")))


def repeated_spans(rows: DataFrame, size: int) -> DataFrame:
    """Spans (rk, start, end) of rows (rk, text) whose bytes stand in repeated windows."""
    whole, members = _scopes_found(rows, size)
    return whole.union(_contested_spans(members, size).where("start >= 0"))


def _scopes_found(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Spans of repeated scopes, joined where they overlap, and the contested scopes with their bytes."""
    live = _live(rows, size)
    sc = rows.sparkSession.sparkContext
    settled = sc.broadcast(c.KeyFilter(live.where("n > 1").select("s1"), "s1"))
    contested = sc.broadcast(c.KeyFilter(live.where("contested").select("core").distinct(), "core"))
    chosen = sc.broadcast(c.KeyFilter(live.where("contested").selectExpr("s1 ^ low as own"), "own"))
    kind = "rk long, anchor long, first long, end long, core long, s1 long, s2 long, body binary"
    found = c.checkpointed(c.map_batches(rows, _candidates(size, settled, contested, chosen), kind).join(live, ["core", "s1", "s2"]))
    whole = found.where("n > 1").groupBy("rk").agg(F.collect_list(F.struct(F.col("first").alias("start"), "end")).alias("spans"))
    whole = c.checkpointed(c.map_batches(whole, _join_spans, "rk long, start long, end long"))
    twins = found.where("contested and n > 1 and rk = low").groupBy("core", "s1", "s2").agg(F.first(F.struct((F.col("anchor") - F.col("first")).alias("rel"), "body")).alias("x"))
    members = found.where("contested and n = 1").select(F.xxhash64("rk", "anchor").alias("mid"), "rk", "first", (F.col("anchor") - F.col("first")).alias("rel"), "body")
    stand_ins = twins.select(F.xxhash64("s1", "s2", "core").alias("mid"), F.col("s1").alias("rk"), F.lit(_ELSEWHERE).cast("long").alias("first"), "x.rel", "x.body")
    return whole, c.checkpointed(members.union(stand_ins))


def suffix_dedup(docs: DataFrame, size: int = 200) -> DataFrame:
    """Every text without the bytes inside a string of ``size`` bytes that also starts anywhere else.

    Texts are UTF-8 bytes; a match lies within one text, its twin may be in the same
    text and overlap it; all is judged on the input. Returns doc_id, n_bytes, n_removed,
    n_spans, kept_sha256 and kept (binary), one row per input row. A null text is empty;
    texts shorter than ``size`` stay whole; repeated rows are copies of each other.
    Other columns are not looked at; an empty table gives an empty result. ``size`` is
    from 8 to 100000 bytes.
    """
    if not 8 <= size <= 100_000:
        raise ValueError(f"size {size} is not from 8 to 100000")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("rk", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    spans = repeated_spans(rows.select("rk", "text"), size).groupBy("rk").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = rows.join(spans, "rk", "left").select("doc_id", "text", "spans")
    return c.map_batches(joined, _remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
