"""Deletion of runs of lines that occurred before, by winnowing, in DataFrame functions only.

Lines with a word are hashed once per text, and the hashes are kept as arrays. The least
hash of every window of ``min_lines`` lines is a fingerprint, so that each run of that
many lines is sure to hold one; a line of ``long_words`` words or more is one by itself.
Only fingerprints are counted. Where one is found twice, each of its positions is joined
with its first, and the match is extended line by line both ways, by 128 bits a line, as
far as the windows go that the fingerprint stands for. Windows that differ from those of
the first position can still be alike among themselves: they go on by a key of 128 bits.
Windows that hang together form a run as long as it goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

_WORD = r"[^\\x20\\x09-\\x0D]"
_NONE = "cast(array() as array<int>)"


def _once(x: Column) -> Column:
    """``x`` as a row of its own, so that it is not computed anew for each element below."""
    return F.explode(F.array(x))


def line_hashes(rows: DataFrame, long_words: int) -> DataFrame:
    """Each text's lines with a word: arrays of places, two hashes, and whether a line is long."""
    lines = f"""filter(transform(split(text, '\\n', -1), (x, i) -> struct(
        i as at, xxhash64(x) as h1, xxhash64('line', x) as h2, x rlike '{_WORD}' as word,
        length(x) >= {2 * long_words - 1} and regexp_count(x, '{_WORD}+') >= {long_words} as long)), x -> x.word)"""
    found = rows.select("r1", "r2", "doc_id", _once(F.expr(lines)).alias("lines")).where("size(lines) > 0")
    return found.select("r1", "r2", "doc_id", "lines.at", "lines.h1", "lines.h2", "lines.long")


def fingerprints(lines: DataFrame, min_lines: int) -> DataFrame:
    """One row per fingerprint: mark, its text, its line ``p`` there, and the lines around it.

    ``a``, ``b`` and ``at`` hold hashes and places from line ``s`` of the text on; ``ks``
    are the first lines of the windows of ``size`` lines that the fingerprint stands for,
    one after the other.
    """
    w = min_lines
    starts = f"if(size(h1) >= {w}, sequence(1, size(h1) - {w} + 1), {_NONE})"
    least = f"k - 1 + array_position(slice(h1, k, {w}), array_min(slice(h1, k, {w})))"
    best = lines.withColumn("best", _once(F.expr(f"transform({starts}, k -> cast({least} as int))")))
    first, last = f"greatest(1, p - {w - 1})", f"least(p, size(h1) - {w - 1})"
    marks = f"""concat(
        transform(array_distinct(best), p -> struct(
            p as p, {first} as s, {w} as size, filter(sequence({first}, {last}), k -> best[k - 1] = p) as ks)),
        transform(filter(sequence(1, size(h1)), k -> long[k - 1]), p -> struct(p as p, p as s, 1 as size, array(p) as ks)))"""
    each = best.select("r1", "r2", "doc_id", "at", "h1", "h2", F.expr(f"inline({marks})"))
    around = [F.expr(f"slice({x}, s, 2 * size - 1)").alias(y) for x, y in (("h1", "a"), ("h2", "b"), ("at", "at"))]
    return each.select(F.expr("h1[p - 1]").alias("mark"), "r1", "r2", "doc_id", "p", "s", "size", "ks", *around)


def extended(found: DataFrame) -> DataFrame:
    """Positions of shared fingerprints, each compared with the first one of the same mark.

    From the mark outwards, lines are alike ``before`` lines back and ``after`` lines on.
    ``gone`` are places of a later position that lie in windows as in the first; ``ks``
    are left with the windows that differ from those of the first.
    """
    key = ["mark", "size"]
    first = found.groupBy(*key).agg(F.min(F.struct("doc_id", "p", "r1", "r2", "s", "a", "b")).alias("first"))
    alike = "get(a, p - s {0} d) = get(first.a, first.p - first.s {0} d) and get(b, p - s {0} d) = get(first.b, first.p - first.s {0} d)"
    steps = f"if(size > 1, sequence(1, size - 1), {_NONE})"
    reach = "aggregate({}, 0, (n, d) -> if(n = d - 1 and {}, d, n))"
    met = found.join(c.stored(first), key).withColumns({
        "before": F.expr(reach.format(steps, alike.format("-"))),
        "after": F.expr(reach.format(steps, alike.format("+"))),
        "met": F.expr("get(b, p - s) = get(first.b, first.p - first.s)"),
    })
    same = met.withColumn("same", F.expr("filter(ks, k -> met and k >= p - before and k + size - 1 <= p + after)"))
    later = "size(same) > 0 and struct(doc_id, p, r1, r2) > struct(first.doc_id, first.p, first.r1, first.r2)"
    # windows of one fingerprint follow one another, and so do those among them that are alike
    lines = "slice(at, array_min(same) - s + 1, array_max(same) - array_min(same) + size)"
    told = same.withColumns({"gone": F.expr(f"if({later}, {lines}, null)"), "ks": F.expr("array_except(ks, same)")})
    left = [F.expr(f"if(size(ks) > 0, {x}, null)").alias(x) for x in ("a", "b", "at")]
    return told.where("gone is not null or size(ks) > 0").select("r1", "r2", "doc_id", "s", "size", "ks", "gone", *left)


def windows_of(found: DataFrame) -> DataFrame:
    """The windows ``ks`` of each position, with their places and keys."""
    part = "slice({}, k - s + 1, size)"
    return found.withColumn("k", F.explode("ks")).select(
        "r1", "r2", "doc_id", "k", F.expr(part.format("at")).alias("at"),
        F.expr(f"xxhash64(size, {part.format('a')})").alias("key"), F.expr(f"xxhash64(size, {part.format('b')})").alias("key2"),
    )


def repeated_lines(rows: DataFrame, min_lines: int, long_words: int) -> DataFrame:
    """Places of the lines of each row (r1, r2, doc_id, text) that lie in a later occurrence of a run."""
    lines = c.stored(line_hashes(rows, long_words))
    marks = fingerprints(lines, min_lines)
    shared = marks.groupBy("mark", "size").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark", "size")
    shared = c.stored(shared)  # joined as it lies, so that a frequent fingerprint's positions can be split
    matches = c.stored(extended(c.stored(marks.join(shared, ["mark", "size"], "left_semi"))))
    windows = c.stored(windows_of(matches.where("size(ks) > 0")))
    order = ["doc_id", "k", "r1", "r2"]
    seen = windows.groupBy("key", "key2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first"))
    others = windows.join(c.stored(seen.where("n > 1")), ["key", "key2"]).where(F.struct(*order) > F.col("first"))
    gone = matches.where("gone is not null").select("r1", "r2", "gone").unionAll(others.select("r1", "r2", "at"))
    return gone.groupBy("r1", "r2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("gone")))).alias("gone"))


def line_dedup(docs: DataFrame, min_lines: int = 2, long_words: int = 50) -> DataFrame:
    """Every text without the runs of lines that occurred earlier.

    A run of ``min_lines`` or more lines with words, or a line of ``long_words`` words
    or more, is deleted unless it is the first in the order of doc_id and place, and then
    of a hash of id and text.
    Lines without words are passed over in matching and kept. Returns doc_id, text (the
    rest), n_lines, n_deleted, n_runs, one row per input row. A null or empty text
    stays as it is, with one line or none; a row repeated with id and text is the same
    document and fares alike; rows of null doc_id come last. Of a run that stands at the
    same line of two texts without an id, or of two texts of one id, one copy stays. Other
    columns are not looked at; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found, name = rest_of_lines(rows, min_lines, long_words)
    runs = "aggregate({0}.gone, struct(-2 as last, 0 as n), (s, i) -> struct(i as last, s.n + if(i > s.last + 1, 1, 0) as n), s -> s.n)"
    return found.select(
        "doc_id",
        F.col(f"{name}.rest").alias("text"),
        F.expr(f"cast(coalesce({_N_LINES}, 0) as long)").alias("n_lines"),
        F.size(f"{name}.gone").cast("long").alias("n_deleted"),
        F.expr(f"cast({runs.format(name)} as long)").alias("n_runs"),
    )


_N_LINES = "1 + length(text) - length(replace(text, '\\n', ''))"


def rest_of_lines(docs: DataFrame, min_lines: int = 2, long_words: int = 50) -> tuple[DataFrame, str]:
    """All columns of the documents and a struct of the places of deleted lines (gone) and what is left (rest).

    Also returns the struct's name, which no column of the documents has.
    """
    r1, r2, held = c.fresh(docs, "r1", "r2", "lines")
    rows = docs.withColumns({r1: F.xxhash64("doc_id", "text"), r2: F.xxhash64(F.lit("row"), "doc_id", "text")})
    texts = rows.where("text is not null")
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc_id")
    gone = repeated_lines(texts.select(F.col(r1).alias("r1"), F.col(r2).alias("r2"), number, "text"), min_lines, long_words)
    joined = rows.join(gone.select(F.col("r1").alias(r1), F.col("r2").alias(r2), F.col("gone").alias(held)), [r1, r2], "left")
    left = "transform(array_except(sequence(0, size(x) - 1), {0}), i -> x[i])".format(held)
    rest = F.expr(f"if({held} is null, text, array_join(transform(array(split(text, '\\n', -1)), x -> {left})[0], '\\n'))")
    both = F.struct(F.coalesce(F.col(held), F.expr(_NONE)).alias("gone"), rest.alias("rest"))
    return joined.select(*docs.columns, both.alias(held)), held
