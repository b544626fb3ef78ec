"""The pipeline's stages: columns, decisions that take effect, and clean documents that stay."""

import collections
import hashlib
import random
import re

import pytest
from test_operators import LOWER, WORD, counts
from test_survivors import survivors

from lattica.llm.queries import WORD_BPE, vocabulary

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, docs, tmp_path):
    spark.createDataFrame([(1, "one two")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at, columns, sizes = docs, docs.columns, []
    for name, stage in pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == columns, name
        path = str(tmp_path / name.replace(" ", "_"))
        at.write.parquet(path)
        at = spark.read.parquet(path)
        sizes.append(at.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    last = pipeline.STAGES[-1][1](spark, at, str(tmp_path))
    assert last.count() == sizes[-1]


def test_names():
    assert len(pipeline.STAGES) == 5 and all(callable(f) for _, f in pipeline.STAGES)


def _corpus():
    """Copies, near copies, repeated lines and passages of the benchmark, a bad host, rows without id, source or text."""
    r = random.Random(8)
    prose = lambda n: " ".join("w%d" % r.randrange(900) for _ in range(n))
    items = [prose(30), prose(16), "short item here"]
    base = [prose(120) for _ in range(6)]
    foot = prose(20) + "\n" + prose(20)
    rows = [(i, base[i % 6] + (" tail%d" % i if i % 3 else ""), "h1") for i in range(18)]
    rows += [(20 + i, prose(60) + "\n" + foot + "\n" + prose(50), "h2") for i in range(5)]
    rows += [(30 + i, prose(40) + " " + items[i % 3] + " " + prose(30), "h2") for i in range(4)]
    rows += [(40 + i, "spam " * 80, "bad") for i in range(6)] + [(50, prose(200), "bad"), (None, prose(90), None), (None, base[0], "h1"), (61, None, "h1"), (62, "", None)]
    return [(i, t, "en", s, len(t or "")) for i, t, s in [*rows, rows[0], rows[20]]], list(enumerate(items))


def _kept_by_quality(rows):
    hosts = collections.defaultdict(list)
    failed = []
    for _, text, _, source, _ in rows:
        x = counts(text)
        failed.append(x[0] < 50 or 100 * x[4] > 50 * x[0])
        hosts[source].append(failed[-1])
    rates = [sum(h) / len(h) for h in hosts.values()]
    m = sum(rates) / len(rates)
    v = sum((x - m) ** 2 for x in rates) / len(rates)
    s = m * (1 - m) / v - 1 if 0 < v < m * (1 - m) else 1.0
    return [r for r, bad in zip(rows, failed, strict=True) if not bad and (sum(hosts[r[3]]) + m * s) / (len(hosts[r[3]]) + s) <= 0.5]


def _without_lines(rows):
    seen, gone = set(), collections.defaultdict(set)
    for key in sorted({(r[0] is None, r[0] or 0, r[1]) for r in rows}):
        lines = [(i, x) for i, x in enumerate(key[2].split("\n")) if WORD.search(x)]
        for k, (i, x) in enumerate(lines):
            if len(WORD.findall(x)) >= 50:
                if x in seen:
                    gone[key].add(i)
                seen.add(x)
            if k + 1 < len(lines):
                pair = (x, lines[k + 1][1])
                if pair in seen:
                    gone[key] |= {i, lines[k + 1][0]}
                seen.add(pair)
    out = []
    for i, t, *more in rows:
        cut = gone[i is None, i or 0, t]
        out.append((i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in cut), *more))
    return out


def _contaminated(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
    w, hit = words(text), set()
    for _, item in items:
        x = words(item)
        m = min(13, len(x))
        wins = {tuple(x[i : i + m]) for i in range(len(x) - m + 1)}
        for i in range(len(w) - m + 1):
            if tuple(w[i : i + m]) in wins:
                hit |= set(range(i, i + m))
    return bool(hit) and 20 * len(hit) >= len(w)


def test_run_equals_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, items = _corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = _kept_by_quality(rows)
    assert 0 < len(kept) < len(rows)
    texts = [(r[0], r[1]) for r in _without_lines(kept)]
    assert sum(map(len, (t for _, t in texts))) < sum(len(r[1]) for r in kept)
    groups = [g[0] for g in survivors(texts)]
    assert len(groups) < len(set(texts))
    clean = [g for g in groups if not _contaminated(g[1], items)]
    assert 0 < len(clean) < len(groups)
    t = Tokenizer.from_file(vocabulary(WORD_BPE))
    t.no_truncation(), t.no_padding()
    want = []
    for i, text in clean:
        ids = t.encode(text, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    found = [tuple(r[x] for x in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(map(str, found)) == sorted(map(str, want))
