"""Fill-in-the-middle, importance resampling and packing against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np

from lattica.llm import fill_in_middle as fim
from lattica.llm import importance as imp
from lattica.llm import packing
from lattica.llm.queries import BYTE_BPE, vocabulary

ODD = ["<P>", "a <S", "x<", "<P", " <M> b", "  lead", "trail \n", "\t\n ", "é ü ß 漢字 😀😀 z", "<S<P<M>", "A<b>c<S d"]
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans(imp.UPPER, imp.LOWER)


def with_odd(spark, rows):
    more = [(1000 + i, ODD[i % len(ODD)] * (1 + i // 40), None, None, 1, i, "c", "c", 1, 2) for i in range(120)]
    more += [(None, "no id at all", None, None, 1, 1, "c", "c", 1, 2)] * 2
    return more, spark.createDataFrame([*rows, *more], spark.createDataFrame([], DOC).schema).repartition(3)


DOC = "doc_id long, text string, lang string, source string, n_chars long, n long, k1 string, spans string, h int, words int"


def test_bits():
    r = np.random.default_rng(1)
    for n, share in ((0, 0), (1, 1), (63, 0.5), (64, 1), (513, 0.02), (5000, 0.3), (70_000, 0.001)):
        flags = r.random(n) < share
        bits = fim.Bits(flags)
        before = np.concatenate([[0], np.cumsum(flags)])
        assert (bits.rank(np.arange(n + 1)) == before).all()
        assert (bits.select(np.arange(before[-1])) == np.flatnonzero(flags)).all()


def formed(doc_id, text):
    text = text or ""
    w = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted(x % (len(w) + 1) for x in h[:2])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return doc_id, len(w), "plain", None, None, text, text
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if h[3] % 100 < 80:
        return doc_id, len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def test_fill_in_middle(spark, rows):
    more, docs = with_odd(spark, rows)
    got = sorted(map(str, map(tuple, fim.restored(fim.fill_in_middle(docs)).collect())))
    want = [formed(r[0], r[1]) for r in [*rows, *more]]
    assert {x[2] for x in want} == {"plain", "spm", "psm"}
    assert got == sorted(map(str, want))


def drawn(rows, target, longest):
    feats, n_words = [], []
    for text in (*[r[1] for r in rows], *target):
        w = WORD.findall((text or "").translate(FOLD))
        n_words.append(len(w))
        feats.append([zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in range(1, longest + 1) for i in range(len(w) - k + 1)])
    s = collections.Counter(b for f in feats[: len(rows)] for b in f)
    t = collections.Counter(b for f in feats[len(rows) :] for b in f)
    all_s, all_t = s.total(), t.total()
    out = []
    for (doc_id, *_), f, n in zip(rows, feats, n_words):
        gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in f]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    first = able[: len(able) * 10 // 100]
    ranks = collections.Counter((*x[:4], k) for k, x in enumerate(first, 1))
    return ranks + collections.Counter((*x[:4], None) for x in out) - collections.Counter((*x[:4], None) for x in first)


def test_importance(spark, rows):
    more, docs = with_odd(spark, rows)
    everything = [*rows, *more]
    target = [rows[9][1], "Alpha1 BETA2 né3 漢字", None, ""]
    bench = spark.createDataFrame([(str(i), x, 7) for i, x in enumerate(target)], "item_id string, text string, doc_id int")
    for longest in (1, 2):
        got = collections.Counter(map(tuple, imp.importance_resample(docs, bench, longest=longest).collect()))
        assert got == drawn(everything, target, longest)
        assert sum(n for x, n in got.items() if x[4]) >= 2


def test_ranks_over_many_tasks(spark):
    """Ties, repeated rows and rows without an id, dealt over several tasks."""
    r = random.Random(4)
    rows = [(None if i % 11 == 0 else i // 2, r.choice((5, 5, 5, r.randrange(40))), i % 7 != 0, i % 3) for i in range(3000)]
    scored = spark.createDataFrame(rows, "doc_id long, score long, enough boolean, tie long").withColumn("row", imp.F.monotonically_increasing_id())
    got = imp.ranked(scored, 60).collect()
    able = sorted((x for x in rows if x[2]), key=lambda x: (-x[1], x[0] is None, x[0] or 0, x[3]))
    first = able[: len(able) * 60 // 100]
    assert sorted(((x["rank"], x["doc_id"], x["score"], x["tie"]) for x in got if x["rank"]), key=lambda x: x[0]) == [(k, x[0], x[1], x[3]) for k, x in enumerate(first, 1)]
    assert len(got) == len(rows)


def test_empty(spark, no_docs):
    bench = spark.createDataFrame([], "item_id string, text string")
    assert fim.restored(fim.fill_in_middle(no_docs)).collect() == []
    assert imp.importance_resample(no_docs, bench).collect() == []
    assert packing.pack(no_docs, vocabulary(BYTE_BPE)).collect() == []


def test_least_squares_and_combinations():
    counts = np.zeros(17, np.int64)
    counts[[16, 10, 6, 3, 4, 5]] = 7, 4, 5, 2, 1, 3
    combined = packing.combinations(counts, 16)
    assert {tuple(sorted(x)) for x in combined.tolist()} == {(0, 0, 16), (0, 6, 10), (3, 3, 10), (4, 6, 6), (5, 5, 6)}
    x = packing.least_squares(combined, counts)
    used = np.bincount(combined.ravel(), np.repeat(x, 3), 17)
    assert (x >= 0).all() and abs(used[16] - 7) < 1e-3
    # no other non-negative repeats fit better: the gradient vanishes where x is positive and is not negative elsewhere
    weight = 1 / np.maximum(counts, 1)
    weight[0] = 0
    slope = (weight * (used - counts))[combined].sum(axis=1)
    assert (slope > -1e-3).all() and (abs(slope[x > 1e-6]) < 1e-3).all()


def test_plans_of_any_lengths():
    r = np.random.default_rng(7)
    for kind in range(12):
        window = int(r.choice([1, 8, 64, 256]))
        counts = np.zeros(window + 1, np.int64)
        at = r.integers(max(1, window * (kind % 3) // 3), window + 1, r.integers(0, 400))
        np.add.at(counts, at, 1)
        if kind % 4 == 0:
            counts[at[:1]] += 3000
        slack = window // 100
        found = packing.plan(counts, slack, 16)
        lengths = np.repeat(np.arange(window + 1), counts)
        ranks = np.concatenate([[], *(np.arange(n) for n in counts)]).astype(np.int64)
        piece, start, n, sequence, offset = found.place(lengths, ranks)
        covered, filled = collections.defaultdict(list), collections.defaultdict(list)
        for p, a, k, s, o in zip(*(x.tolist() for x in (piece, start, n, sequence, offset)), strict=True):
            covered[p].append((a, k))
            filled[s].append((o, k))
        assert len(covered) == len(lengths) and sorted(filled) == list(range(len(filled)))
        for p, x in covered.items():
            assert gapless(x) == lengths[p]
        sizes = [gapless(x) for x in filled.values()]
        assert all(x >= window - slack or x & (x - 1) == 0 for x in sizes) and max(sizes, default=0) <= window
        assert len(sizes) <= lengths.sum() / max(1, window - slack) + 12


def gapless(parts):
    at = 0
    for start, n in sorted(parts):
        assert start == at and n > 0
        at += n
    return at


def test_packing(spark, rows):
    from tokenizers import Tokenizer

    more, docs = with_odd(spark, rows)
    texts = ["<|endoftext|>", "a<|endoftext|> b", "x" * 30_000, " " * 9000 + "y", "word " * 2047, "word " * 2046]
    extra = [(5000 + i, x, None, None, 1, i, "c", "c", 1, 2) for i, x in enumerate(texts)]
    everything = [*rows, *more, *extra]
    docs = spark.createDataFrame(everything, docs.schema).repartition(3)
    library = Tokenizer.from_file(vocabulary(BYTE_BPE))
    want = collections.Counter((r[0], tuple([*library.encode(r[1] or "", add_special_tokens=False).ids, 1])) for r in everything)
    for window, slack in ((2048, 20), (64, 0)):
        got = packing.pack(docs, vocabulary(BYTE_BPE), window=window, slack=slack, with_ids=True).collect()
        plain = packing.pack(docs, vocabulary(BYTE_BPE), window=window, slack=slack).collect()
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
        assert sorted(str([r[x] for x in names]) for r in got) == sorted(str([r[x] for x in names]) for r in plain)
        sequences, starts = collections.defaultdict(list), collections.defaultdict(list)
        for r in got:
            assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
            starts[r["doc_id"], r["doc_tokens"], r["start"]].append(np.frombuffer(r["ids"], "<u4"))
        sizes = [gapless(x) for x in sequences.values()]
        assert max(sizes) <= window and all(x >= window - slack or x & (x - 1) == 0 for x in sizes)
        ids = collections.defaultdict(list)
        for doc_id, n, at in starts:
            ids[doc_id].append((at, n))
        for (doc_id, whole), n in want.items():
            if n == 1 and sum(x[0] == doc_id for x in want.elements()) == 1:
                parts = sorted((at, p[0]) for (d, _, at), p in starts.items() if d == doc_id)
                assert tuple(np.concatenate([p for _, p in parts]).tolist()) == whole
                assert gapless([(at, len(p)) for at, p in parts]) == len(whole)
        assert sum(len(x) * n for (_, x), n in want.items()) == sum(r["length"] for r in got)
