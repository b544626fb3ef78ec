"""Slots that failures give back: as a batch, as a stream, and against a plain list of times."""

import datetime as dt
import random
import tempfile

from lattica.streaming import events as ev

START = dt.datetime(2024, 1, 1)
LOG = "user string, at timestamp, row string, frees string"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def run(spark, rows, **settings):
    log = spark.createDataFrame([(u, at(t), r, f) for u, t, r, f in rows], LOG).repartition(3)
    return {r["row"]: (r["allowed"], r["retry_after"]) for r in ev.rate_release(log, "user", "at", "row", "frees", **settings).collect()}


def five(user, n=5):
    return [(user, k, f"{user}+{k}", None) for k in range(n)]


def test_a_released_slot_is_free_again(spark):
    rows = [*five("a", 6), ("a", 10, "a-0", "a+0"), ("a", 11, "a+x", None), ("a", 12, "a+y", None)]
    got = run(spark, rows)
    assert [got[f"a+{k}"][0] for k in range(6)] == [True] * 5 + [False]
    assert got["a-0"] == (True, 0) and got["a+x"] == (True, 0) and got["a+y"] == (False, 600 - 11)


def test_a_rejected_attempt_has_no_slot_to_give_back(spark):
    rows = [*five("a", 6), ("a", 10, "a-5", "a+5"), ("b", 10, "b-0", "b+0"), ("b", 10, "b-1", "a+1"), ("a", 11, "a+x", None)]
    got = run(spark, rows)
    assert got["a-5"] == got["b-0"] == got["b-1"] == (False, 0) and not got["a+x"][0]


def tried(spark, outcome):
    """Quota of one user whose first attempt ends in some way, by how many more get through."""
    rows = [(1, at(0), at(5), outcome)] + [(k, at(8 + k), at(9 + k), "ok") for k in range(2, 9)]
    attempts = spark.createDataFrame([("u", *r) for r in rows], "user string, n int, start timestamp, ended timestamp, outcome string")
    log = ev.outcomes(attempts, "user", "start", "n", "ended", attempts["outcome"].isin("timeout", "failure"))
    found = ev.rate_release(log, "user", "at", "row", "frees").collect()
    return sum(r["allowed"] for r in found if r["row"].startswith("+") and r["row"] != "+1")


def test_time_outs_and_failures_cost_nothing(spark):
    assert tried(spark, "timeout") == tried(spark, "failure") == 5


def test_a_place_without_data_still_costs_a_slot(spark):
    assert tried(spark, "no coverage") == tried(spark, "bad request") == tried(spark, None) == 4


def test_a_slot_out_of_its_window_is_not_given_back_twice(spark):
    rows = [*five("a"), ("a", 601, "a+x", None), ("a", 602, "a-0", "a+0"), ("a", 602.5, "a+y", None), ("a", 603, "a-x", "a+x"), ("a", 603.5, "a-x2", "a+x")]
    got = run(spark, rows)
    assert got["a+x"][0] and got["a-0"] == (False, 0) and got["a-x"] == (True, 0) and got["a-x2"] == (False, 0)


def plain(rows, most, seconds):
    held, out = {}, {}
    for user, t, row, frees in sorted(rows, key=lambda r: (r[1], r[2])):
        mine = [x for x in held.get(user, []) if t - x[0] < seconds]
        if frees:
            out[row] = (any(x[1] == frees for x in mine), 0)
            mine = [x for x in mine if x[1] != frees]
        elif len(mine) < most:
            mine.append((t, row))
            out[row] = (True, 0)
        else:
            out[row] = (False, max(1, int(seconds - (t - mine[0][0]))))
        held[user] = mine
    return out


def made():
    r, rows = random.Random(6), []
    for k in range(600):
        user, t = r.choice("abbbbbc"), r.randrange(4000)
        rows.append((user, t, f"+{k}", None))
        if r.random() < 0.5:
            rows.append((user, t + r.randrange(200), f"-{k}", f"+{k}"))
    return rows


def test_many_rows_as_by_plain_lists(spark):
    rows = made()
    assert run(spark, rows, most=3, seconds=300) == plain(rows, 3, 300)


def test_stream_equals_batch(spark):
    """Several micro-batches and a restart from the checkpoint."""
    rows = sorted(made(), key=lambda r: (r[1], r[2]))
    source, kept = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    got = {}

    def sink(batch, _):
        got.update({r["o"]: (r["allowed"], r["retry_after"]) for r in batch.collect()})

    cuts = [0, 150, 400, len(rows)]
    for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
        # rows of one moment stay together: a batch does not look back
        chunk = [r for r in rows if (rows[a][1] if a else -1) <= r[1] < (rows[b][1] if b < len(rows) else 1e9)]
        spark.createDataFrame([(u, at(t), r, f) for u, t, r, f in chunk], LOG).coalesce(1).write.mode("append").json(source)
        if part != 1:  # the second part is read after a restart, together with the third
            log = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).json(source)
            limited = ev.stream_rate_release(log, "user", "at", "row", "frees", 3, 300)
            limited.writeStream.foreachBatch(sink).option("checkpointLocation", kept).trigger(availableNow=True).start().awaitTermination()
    assert got == plain(rows, 3, 300)
