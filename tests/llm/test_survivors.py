"""The pipeline's near duplicates by brute force, with documents that have no id and ids that have several texts."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def _shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def survivors(rows):
    """Distinct (doc_id, text), the first by id (none last) of each component."""
    nodes = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    sets = [_shingles(t) for _, t in nodes]
    root = list(range(len(nodes)))
    for _ in nodes:
        for a in range(len(nodes)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    root[a] = root[b] = min(root[a], root[b])
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, []).append(nodes[i])
    return groups.values()


def _text(seed, n=80):
    r = random.Random(seed)
    return " ".join("w%d" % r.randrange(500) for _ in range(n))


def _kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "h", len(t or "")) for i, t in rows], KIND)
    return sorted(map(str, ((r["doc_id"], r["text"]) for r in pipeline.near_duplicates(spark, docs, "").collect())))


def test_rows_without_id(spark):
    unique, repeated, near = _text(1), _text(2), _text(3)
    rows = [(None, unique), (None, repeated), (None, repeated), (None, near), (None, near + " end"), (4, _text(4)), (None, _text(4)), (9, _text(5)), (7, _text(5) + " end"), (None, _text(5)), (None, "")]
    found = _kept(spark, rows)
    groups = survivors(rows)
    assert len(found) == len(groups) == 6
    for group in groups:
        first = [g for g in group if g[0] is not None][:1] or group
        assert sum(str(g) in found for g in first) == 1 and sum(str(g) in found for g in group) == 1


def test_an_id_with_several_texts(spark):
    assert _kept(spark, [(3, _text(1)), (5, _text(1)), (5, _text(2)), (5, _text(2))]) == sorted(map(str, [(3, _text(1)), (5, _text(2))]))


def test_all_ids(spark):
    rows = [(i, _text(i // 3) + " end" * (i % 3)) for i in range(30)] + [(30, None), (31, "")]
    assert _kept(spark, rows) == sorted(str(g[0]) for g in survivors(rows))
