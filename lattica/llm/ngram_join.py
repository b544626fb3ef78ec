"""Exact Jaccard join of documents over word shingles, down to components.

Documents with equal sets are one class. The incidence matrix of classes by
shingles is cut into blocks of columns by hash, several times as many as a linked pair
may have differing shingles: in one order for all, large blocks first and frequent
ones last, one of the first blocks of both sets then has to be equal, and only pairs
with such a block are multiplied at all. Their overlap is accumulated over a first
part of the columns, pairs that the sizes of what is left cannot bring to the needed
overlap are discarded, and the others are counted to the end. Before a pair is formed at
all, its overlap is bounded by the incidence matrix folded to FOLDED columns modulo two:
each column in which two folded rows differ holds a shingle that only one set has. Pairs
are first formed with one pivot of each set only, the one that shares most, and later
between different components only, so that a large group of near copies never yields all
its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .components import components

#: Entries of the list of frequent blocks (8 bytes each); it only sets an order, any list gives the same result.
FREQUENT = 65_536
_FLUSH = 2_500_000
#: Blocks for each shingle that may differ.
_FINE = 5
#: Pairs for each posting beyond which another round with pivots comes first.
_MANY = 20
#: Hashes below this are the first part of the columns, an eighth.
_PART = np.uint64(1 << 61)
#: Nodes of rows without an id are numbered from here.
_NO_ID = 1 << 62
#: Columns of the folded incidence matrix, a row of which bounds overlaps; eight numbers of 64 bits.
FOLDED = 512
_FOLDS = tuple(f"f{i}" for i in range(FOLDED // 64))


def sets_of(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text of a chunk, sorted."""
    data = c.LOWER[data]
    starts, ends = c.runs(~c.SPACE[data], offsets)
    first = c.first_of(starts, offsets)
    words = c.Hasher(data)(starts, ends)
    hashes, at = c.shingles(words, first, k)
    out = []
    for i in range(len(offsets) - 1):
        n = first[i + 1] - first[i]
        if n >= k:
            out.append(np.unique(hashes[at[i] : at[i + 1]]))
        elif n:
            own = np.uint64(n)
            for w in words[first[i] : first[i + 1]]:
                own = c.mix(np.array([own ^ w]))[0]
            out.append(np.array([own], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Blocks:
    """Tokens of sets: sets that reach the similarity have one in common.

    Sizes fall into classes such that linked sets are of the same class or of
    adjoining ones; a set takes part in the cuttings of its own class and of the one
    below. With ``d`` shingles at most that differ, a cutting has more than d blocks,
    of which all but d are equal in both sets; in one order for all, the first d + 1
    blocks of each set then have an equal one among them.
    """

    def __init__(self, percent: int, frequent: np.ndarray | None = None):
        self.percent = percent
        low = [1]
        while low[-1] < 1 << 40:
            low.append(100 * low[-1] // percent + 1)
        self.low = np.array(low, np.int64)
        self.high = self.low[1:] - 1
        self.blocks = _FINE * (1 + self.differing(self.high, 100 * self.high // percent))
        frequent = np.zeros(0, np.uint64) if frequent is None else frequent
        self.rank = np.argsort(frequent)
        self.known = frequent[self.rank]

    def differing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Shingles at most that are in one only of two linked sets of these sizes."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def place(self, token: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Larger blocks first, then the frequent ones by frequency, empty ones last."""
        out = -size
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, token), len(self.known) - 1)
            out = np.where(self.known[at] == token, self.rank[at] + 1, out)
        return np.where(size == 0, len(self.known) + 1, out)

    def tokens(self, sets: list[np.ndarray], every: bool = False) -> tuple[np.ndarray, ...]:
        """Tokens of all sets, the number of the set of each, the token before it (0: none), and bits of the blocks before it; of every block that is not empty, if wanted."""
        found = [self._cut(sets, below, every) for below in (0, 1)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _cut(self, sets: list[np.ndarray], below: int, every: bool) -> tuple[np.ndarray, ...]:
        n = np.array([len(x) for x in sets], np.int64)
        kind = np.searchsorted(self.low, n, "right") - 1 - below
        most = self.high[np.maximum(kind, 0)] if below else 100 * n // self.percent
        keep = self.differing(n, most)
        use = np.flatnonzero((keep > 0) & (kind >= 0) & (100 * most >= self.percent * n))
        if not len(use):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        n, kind, keep = n[use], kind[use], keep[use]
        hashes, of = np.concatenate([sets[i] for i in use]), np.repeat(np.arange(len(use)), n)
        m = self.blocks[kind]
        base = np.concatenate([[0], np.cumsum(m)])
        at = base[of] + (((hashes >> np.uint64(32)) * m[of].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        sums = np.zeros(base[-1], np.uint64)
        np.add.at(sums, at, c.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)))
        sizes, which = np.bincount(at, minlength=base[-1]), np.repeat(np.arange(len(use)), m)
        number = (kind[which] << 32) + np.arange(base[-1]) - base[which]
        token = c.mix(sums ^ c.mix(number.astype(np.uint64) + np.uint64(1)))
        if every:
            return token[sizes > 0], use[which[sizes > 0]], np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        order = np.lexsort((token, self.place(token, sizes), which))
        rank, token = np.arange(len(order)) - base[which], token[order]
        first = rank <= keep[which]
        before = np.where(rank > 0, np.roll(token, 1), np.uint64(0))
        bits = np.uint64(1) << ((order - base[which])[first] % 64).astype(np.uint64)
        mask, start = np.zeros(len(bits), np.uint64), 0
        for size in (keep + 1).tolist():
            mask[start + 1 : start + size] = np.bitwise_or.accumulate(bits[start : start + size - 1])
            start += size
        return token[first], use[which[first]], before[first], mask


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(x) for x in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), _long(np.concatenate(rows) if rows else np.zeros(0, np.uint64)))


def folded(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 64-bit numbers for each set: its incidence row folded to FOLDED columns, modulo two."""
    out = np.zeros((len(sets), len(_FOLDS)), np.uint64)
    n = np.array([len(x) for x in sets], np.int64)
    if n.sum():
        hashes, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        column = (hashes & np.uint64(FOLDED - 1)).astype(np.int64)
        odd = np.bincount(of * FOLDED + column, minlength=len(sets) * FOLDED).reshape(-1, FOLDED) & 1
        out = np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)
    return out


def _within(a: str, b: str, percent: int) -> str:
    """SQL: whether the folded rows of two sets let them be linked; ``a`` and ``b`` name a column of each side."""
    differing = " + ".join(f"bit_count({a.format(x)} ^ {b.format(x)})" for x in _FOLDS)
    return f"{100 + percent} * ({differing}) <= {100 - percent} * ({a.format('n')} + {b.format('n')})"


def _keys(sets: list[np.ndarray]) -> list[np.ndarray]:
    """A 128-bit key of each set, in two halves."""
    return [np.array([c.mix(x ^ np.uint64(salt)).sum(dtype=np.uint64) for x in sets], np.uint64) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]


def _each_chunk(k: int, make: Callable[[pa.RecordBatch, list[np.ndarray]], dict[str, pa.Array]], passed=None) -> Callable:
    """A map over batches that hands on the sets of each chunk; only of rows whose ``h`` a filter passes, if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if passed is not None:
                batch = batch.filter(pa.array(passed.value(batch.column("h").to_numpy())))
            for part, data, offsets in c.chunks(batch, "text"):
                made = make(part, sets_of(data, offsets, k))
                yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

    return run


def _measured(rows: DataFrame, k: int) -> DataFrame:
    def make(part: pa.RecordBatch, sets: list[np.ndarray]) -> dict[str, pa.Array]:
        k1, k2 = map(_long, _keys(sets))
        rows = folded(sets)
        folds = {x: _long(np.ascontiguousarray(rows[:, i])) for i, x in enumerate(_FOLDS)}
        return {"id": part.column("id"), "doc_id": part.column("doc_id"), "n": pa.array([len(x) for x in sets], pa.int64()), "k1": k1, "k2": k2} | folds

    kind = "id long, doc_id long, n long, k1 long, k2 long" + "".join(f", {x} long" for x in _FOLDS)
    return c.checkpointed(c.map_batches(rows.select("id", "doc_id", "text"), _each_chunk(k, make), kind))


def _count_frequent(k: int, percent: int) -> Callable:
    """Tokens found in several of some thousands of documents, with how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        blocks = Blocks(percent)

        def flush() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= 5
            held.clear()
            return pa.RecordBatch.from_arrays([_long(found[often]), pa.array(n[often].astype(np.int64))], names=["token", "n"])

        for batch in batches:
            for _, data, offsets in c.chunks(batch, "text"):
                held.append(blocks.tokens(sets_of(data, offsets, k), every=True)[0])
                if sum(map(len, held)) > _FLUSH:
                    yield flush()
        if held:
            yield flush()

    return run


def frequent_tokens(rows: DataFrame, k: int, percent: int) -> np.ndarray:
    """Up to FREQUENT of the most frequent tokens, the most frequent last."""
    found = c.map_batches(rows.select("text"), _count_frequent(k, percent), "token long, n long")
    top = found.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT).collect()
    return np.array([r["token"] for r in top[::-1]], np.int64).view(np.uint64)


def _posted(rows: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Tokens that several classes have, and the postings (token, before, mask, doc_id, n) of about these."""
    text = rows.select("doc_id", "text")

    def all_tokens(part: pa.RecordBatch, sets: list[np.ndarray]) -> dict[str, pa.Array]:
        token, of, *_ = blocks.tokens(sets)
        return {"token": _long(token), "k1": _long(_keys(sets)[0][of])}

    def shared_tokens(part: pa.RecordBatch, sets: list[np.ndarray]) -> dict[str, pa.Array]:
        token, of, before, mask = blocks.tokens(sets)
        take = passed.value(token)
        token, of, before, mask = token[take], of[take], before[take], mask[take]
        return {"token": _long(token), "before": _long(before), "mask": _long(mask), "doc_id": part.column("doc_id").take(pa.array(of)), "n": pa.array(np.array([len(x) for x in sets], np.int64)[of])}

    blocks = Blocks(percent, frequent_tokens(rows, k, percent))
    every = c.map_batches(text, _each_chunk(k, all_tokens), "token long, k1 long")
    shared = c.checkpointed(every.groupBy("token").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).where("low < high").select("token"))
    passed = rows.sparkSession.sparkContext.broadcast(c.KeyFilter(shared, "token"))
    return shared, c.map_batches(text, _each_chunk(k, shared_tokens), "token long, before long, mask long, doc_id long, n long")


def _linked(pairs: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b, n_a, n_b) that reach the similarity."""

    def make(part: pa.RecordBatch, sets: list[np.ndarray]) -> dict[str, pa.Array]:
        cuts = [int(np.searchsorted(x, _PART)) for x in sets]
        head, rest = ([x[:i] for x, i in zip(sets, cuts, strict=True)], [x[i:] for x, i in zip(sets, cuts, strict=True)])
        return {"doc_id": part.column("doc_id"), "head": _lists(head), "rest": _lists(rest)}

    pairs = c.checkpointed(pairs)
    wanted = c.checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().withColumn("h", F.xxhash64("doc_id")))
    passed = rows.sparkSession.sparkContext.broadcast(c.KeyFilter(wanted, "h"))
    coded = c.map_batches(rows.select("doc_id", "text", F.xxhash64("doc_id").alias("h")), _each_chunk(k, make, passed), "doc_id long, head array<long>, rest array<long>")
    sets = c.checkpointed(coded.join(wanted.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id", "head", "rest"]))
    side = lambda x, part: sets.select(F.col("doc_id").alias(x), F.col(part).alias(f"{part}_{x}"))
    need = F.expr(f"{percent} * (n_a + n_b)")
    common = lambda part: F.size(F.array_intersect(f"{part}_a", f"{part}_b"))
    begun = (
        pairs.join(side("a", "head"), "a")
        .join(side("b", "head"), "b")
        .withColumn("common", common("head"))
        .where((100 + percent) * F.expr("common + least(n_a - size(head_a), n_b - size(head_b))") >= need)
        .select("a", "b", "n_a", "n_b", "common")
    )
    return begun.join(side("a", "rest"), "a").join(side("b", "rest"), "b").where((100 + percent) * (F.col("common") + common("rest")) >= need).select("a", "b")


def _with_pivots(mixed: DataFrame, hubs: bool, percent: int) -> DataFrame:
    """One pair for each set: with a pivot of another component among those it shares a token with.

    Of each token the pivot is the set that shares most, or one by hash.
    """
    counted = mixed.groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    if hubs:
        share = mixed.join(counted, "token").groupBy("cid").agg((-F.sum("c")).alias("rank"))
    else:
        share = mixed.select("cid", F.xxhash64("cid").alias("rank")).distinct()
    ranked = c.checkpointed(mixed.join(share, "cid"))
    pivots = ranked.groupBy("token").agg(F.min(F.struct("rank", "cid", "n", "label", *_FOLDS)).alias("p"))
    tried = ranked.join(pivots, "token").where("label <> p.label").where(_within("{}", "p.{}", percent))
    chosen = tried.groupBy("cid", "n").agg(F.min(F.struct("p.rank", "p.cid", "p.n")).alias("p"))
    return chosen.select(F.col("cid").alias("a"), F.col("p.cid").alias("b"), F.col("n").alias("n_a"), F.col("p.n").alias("n_b"))


def _all_pairs(mixed: DataFrame, percent: int) -> DataFrame:
    """The pairs of sets of different components whose first common token is one of these.

    A pair that shares the token before it too is found there. At the first common
    token all blocks before it differ, each by a shingle at least, so their number in
    both orders together bounds the overlap, as the folded rows do. Of each token the
    largest component meets the others only: its own sets are never paired.
    """
    sizes = mixed.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
    largest = sizes.groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("top"))
    kept = ("cid", "n", "label", "before", "mask", *_FOLDS)
    side = lambda s: mixed.select("token", *(F.col(v).alias(f"{v}_{s}") for v in kept))
    others = side("a").join(largest, "token").where("label_a <> top")
    joined = (
        others.join(side("b"), "token")
        .where("label_a <> label_b and (label_b = top or cid_a < cid_b) and (before_a = 0 or before_a <> before_b)")
        .where(f"{100 + percent} * bit_count(mask_a | mask_b) <= {100 - percent} * (n_a + n_b)")
        .where(_within("{}_a", "{}_b", percent))
    )
    return joined.select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b"), "n_a", "n_b").distinct()


def ngram_jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard index of percent / 100 or more.

    Returns doc_id, n_shingles, component_id, one row per input row. Words are runs of
    characters other than ASCII white space, A-Z in lower case; shingles are k words,
    or the whole sequence of a shorter text. A null text or one without words has an
    empty set and is linked with nothing. A repeated row is linked with its twin; rows
    of one doc_id are one node. A row of null doc_id is a node of its text, after all
    ids: the component's number is then its smallest id, or one made of a text if none
    of its rows has an id. Other columns are not looked at; an empty table gives an
    empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("doc_id", F.coalesce("id", F.expr("shiftrightunsigned(xxhash64(text), 2)") + _NO_ID))
    measured = _measured(rows, k)
    each = measured.where("n > 0").groupBy("k1", "k2")
    classes = c.checkpointed(each.agg(F.min("doc_id").alias("cid"), F.min("n").alias("n"), *(F.min(x).alias(x) for x in _FOLDS)))
    shared, postings = _posted(rows, k, percent)
    known = classes.select(F.col("cid").alias("doc_id")).distinct()
    live = postings.join(shared, "token", "left_semi").join(known, "doc_id", "left_semi")
    live = c.checkpointed(live.select("token", "before", "mask", F.col("doc_id").alias("cid"), "n").distinct())
    folds = classes.select("cid", "n", *_FOLDS)
    roots = None
    for step in range(4):
        label = F.col("cid") if roots is None else F.coalesce("root", "cid")
        labelled = (live if roots is None else live.join(roots, live["cid"] == roots["node"], "left")).select("token", "before", "mask", "cid", "n", label.alias("label"))
        several = labelled.groupBy("token").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count(F.lit(1)).alias("c")).where("l < h")
        several = c.checkpointed(several.select("token", "c"))
        postings, pairs = several.agg(F.sum("c"), F.sum(F.expr("c * (c - 1) / 2"))).first()
        if not postings:
            break
        mixed = c.checkpointed(labelled.join(several.select("token"), "token").join(folds, ["cid", "n"]))
        last = step and (pairs <= _MANY * postings or step == 3)
        links = _linked(_all_pairs(mixed, percent) if last else _with_pivots(mixed, step == 0, percent), rows, k, percent)
        roots = c.checkpointed(components(links if roots is None else links.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))))
        if last:
            break
    members = classes.select(F.col("k1").alias("m1"), F.col("k2").alias("m2"), F.col("cid").alias("component_id"))
    if roots is not None:
        members = members.join(roots, members["component_id"] == roots["node"], "left").select("m1", "m2", F.coalesce("root", "component_id").alias("component_id"))
    found = measured.join(members, (F.col("n") > 0) & (F.col("k1") == F.col("m1")) & (F.col("k2") == F.col("m2")), "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("component_id", "doc_id"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))
