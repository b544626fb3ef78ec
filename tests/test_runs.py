"""Curves of evaluation runs: chunks that end anywhere, late ones, and a restart."""

import json
import random
import tempfile
import time

import pytest

from lattica.streaming import runs

CHUNK = "run string, seq long, text string"


def text_of(name, seed):
    r = random.Random(seed)
    lines = [{"event": "status", "message": "é"}, {"event": "progress", "pct": 1, "pixel_train_count": 5, "classifiers": {"rf": {"mean_f1": 0.5}}}]
    lines.append({"event": "start", "task": "regression" if seed % 2 else "classification", "classifiers": ["rf", "unet"], "total_labelled_pixels": 200})
    for pct in (1, 3, 5, 10):
        score = {f"{a}_{b}": r.uniform(-1, 1) if a == "mean" else 0.7 for a in ("mean", "std") for b in ("f1", "r2")}
        lines += [{"event": "heartbeat"}, {"event": "progress", "message": "tiles"}, "broken {", [1], {"event": "progress", "pct": pct, "pixel_train_count": 2 * pct, "unet_train_count": 7, "classifiers": {"rf": score, "unet": score, "other": score}}]
    lines.append({"event": "start", "classifiers": ["nn"], "total_labelled_pixels": None})
    lines.append({"event": "progress", "pct": 80, "pixel_train_count": 1, "classifiers": {"nn": {"mean_f1": 0.9, "std_f1": 0.2}, "rf": {"mean_f1": 0.1}}})
    return "\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n"


def chunked(text, seed):
    r, at, out = random.Random(seed), 0, []
    while at < len(text):
        n = r.choice((1, 7, 60, 300))
        out.append(text[at : at + n])
        at += n
    return out


def expected(text):
    """Straight from the lines."""
    out, known = [], None
    for line in text.split("\n"):
        try:
            e = json.loads(line)
        except ValueError:
            continue
        if isinstance(e, dict) and e.get("event") == "start":
            known = e
        elif isinstance(e, dict) and e.get("event") == "progress" and "classifiers" in e and known:
            for m in [m for m in e["classifiers"] if m in known["classifiers"]]:
                s, b = e["classifiers"][m], "r2" if known.get("task") == "regression" else "f1"
                low, high = s[f"mean_{b}"] - s[f"std_{b}"], s[f"mean_{b}"] + s[f"std_{b}"]
                n = e["unet_train_count"] if m == "unet" else e["pixel_train_count"]
                out.append((m, float(e["pct"]), n / (known.get("total_labelled_pixels") or 1) * 100, s[f"mean_{b}"], *((low, high) if b == "r2" else (max(0, low), min(1, high)))))
    return sorted(out)


def by_run(rows):
    out = {}
    for r in rows:
        out.setdefault(r["run"], []).append(tuple(r[x] for x in ("model", "pct", "x", "mean", "low", "high")))
    return {k: sorted(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def given():
    texts = {f"r{k}": text_of(f"r{k}", k) for k in range(4)}
    return texts, [(name, i, c) for k, (name, t) in enumerate(texts.items()) for i, c in enumerate(chunked(t, k))]


def test_batch(spark, given):
    texts, rows = given
    df = spark.createDataFrame([*rows, *rows[:5], (None, 0, "x"), ("gap", 1, texts["r0"]), ("none", 0, None)], CHUNK).repartition(3)
    got = by_run(runs.curve_points(df, "run", "seq", "text").collect())
    assert got == {k: expected(t) for k, t in texts.items()}
    assert any(low < 0 for _, _, _, _, low, _ in got["r1"]) and len(got["r0"]) == 9
    assert runs.curve_points(df.limit(0), "run", "seq", "text").collect() == []


def test_stream_with_late_rows_and_a_restart(spark, given):
    texts, rows = given
    r = random.Random(9)
    mixed = list(rows)
    for i in range(0, len(mixed), 5):  # many come before their turn, and some twice
        j = min(len(mixed) - 1, i + r.randrange(25))
        mixed[i], mixed[j] = mixed[j], mixed[i]
    mixed += rows[:20]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, kept = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    out = tempfile.mkdtemp(prefix="spark-")
    third = len(mixed) // 3
    for part in range(3):
        spark.createDataFrame(mixed[part * third : (part + 1) * third if part < 2 else None], CHUNK).coalesce(1).write.mode("append").json(source)
        if part == 1:
            continue  # read after the restart, with the last part, in two micro-batches
        stream = spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", 1).json(source)
        points = runs.stream_curve_points(stream, "run", "seq", "text")
        query = points.writeStream.format("json").option("path", f"{out}/points").option("checkpointLocation", kept).outputMode("append").trigger(processingTime="1 second").start()
        due = third if part == 0 else len(mixed) - third
        try:
            for _ in range(120):  # with a timer set, batches go on for ever
                if sum(p["numInputRows"] for p in query.recentProgress) >= due or query.exception():
                    break
                time.sleep(0.5)
        finally:
            query.stop()
        assert query.exception() is None
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.schema(f"run string, {runs.POINT}").json(f"{out}/points").collect()
    assert by_run(got) == {k: expected(t) for k, t in texts.items()}
