"""Every operator against brute force on a small table that holds the odd cases."""

import collections
import hashlib
import random
import re

import pytest

from lattica.llm import bpe, chat, classifier, decontaminate, line_dedup, ngram_join, pii, quality_rules, suffix_dedup, token_counts
from lattica.llm.queries import PIECES, PLANTED, WORD_BPE, vocabulary

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_empty_tables(spark, no_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    known = spark.createDataFrame([], "doc_id long, quality int")
    path = vocabulary(WORD_BPE)
    for found in (
        chat.chat_digests(turns), quality_rules.quality_rules(no_docs), ngram_join.ngram_jaccard_join(no_docs), pii.find_pii(no_docs, pii.Tagger()), line_dedup.line_dedup(no_docs),
        decontaminate.decontaminate(no_docs, bench), classifier.quality_classifier(no_docs, known), token_counts.token_counts(no_docs, {}), bpe.bpe_encode(no_docs, path), suffix_dedup.suffix_dedup(no_docs),
    ):
        assert found.collect() == []


def test_chat(spark):
    texts = [PLANTED, "[\\INST]", "<\\\\s>", "[NEXT][:][AS]", "", None, "a\nb", "<s></s>[/INST][OUT]", "[\\NEXT] \\ $1"]
    rows = [(1, i, ("user", "assistant", "system", None)[i % 4], t, 9) for i, t in enumerate(texts)]
    rows += [(2, 0, "assistant", x, 9) for x in ("x", "y", "x")] + [(None, None, "[:]", "odd", 9), (3, 5, "user", "late", 9), (3, None, "user", "early", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, starts int")
    found = {r["conv_id"]: r for r in chat.chat_digests(df).collect()}
    parsed = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.parse_chats(chat.format_chats(df)).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in (1, 2, 3, None):
        mine = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        assert parsed[conv] == mine
        loss = "".join(t for x, t in mine if x == "assistant")
        assert (found[conv]["n_turns"], found[conv]["turns_sha256"]) == (len(mine), sha("".join(f"{a}\n{b}\n" for a, b in mine)))
        assert (found[conv]["loss_chars"], found[conv]["loss_sha256"]) == (len(loss), sha(loss))


def counts(text):
    w = WORD.findall(text or "")
    where = collections.defaultdict(list)
    for i in range(len(w) - 2):
        where[tuple(w[i : i + 3])].append(i)
    hit = {i + j for x in where.values() if len(x) > 1 for i in x for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(docs, rows):
    want, hosts = [], collections.defaultdict(list)
    for r in rows:
        x = counts(r[1])
        failed = x[0] < 50 or 100 * x[4] > 50 * x[0]
        hosts[r[3]].append(failed)
        want.append((r[0], *x, failed, r[3]))
    rates = [sum(h) / len(h) for h in hosts.values()]
    m = sum(rates) / len(rates)
    v = sum((x - m) ** 2 for x in rates) / len(rates)
    s = m * (1 - m) / v - 1 if 0 < v < m * (1 - m) else 1.0
    good = {h: (sum(x) + m * s) / (len(x) + s) <= 0.5 for h, x in hosts.items()}
    found = quality_rules.quality_rules(docs)
    assert got(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept") == sorted((*w[:-1], not w[6] and good[w[7]]) for w in want)


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(docs, rows, k, percent):
    sets = {}
    for r in rows:
        w = WORD.findall((r[1] or "").translate(LOWER))
        sets[r[0]] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    root[a] = root[b] = min(root[a], root[b])
    assert got(ngram_join.ngram_jaccard_join(docs, k, percent)) == sorted((r[0], len(sets[r[0]]), root[r[0]]) for r in rows)


def test_ngram_join_of_a_large_group(spark):
    """A hub, copies near it or not, and no link lost between them."""
    hub = ["w%d" % i for i in range(60)]
    texts = [" ".join(hub)] + [" ".join("x%d" % k if i == k or (k % 2 and i == (7 * k) % 60) else w for i, w in enumerate(hub)) for k in range(1, 55)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [frozenset(zip(t.split(), t.split()[1:], t.split()[2:])) for t in texts]
    root = list(range(len(sets)))
    for _ in range(6):
        for a in range(len(sets)):
            for b in range(a):
                n = len(sets[a] & sets[b])
                if 100 * n >= 90 * (len(sets[a]) + len(sets[b]) - n):
                    root[a] = root[b] = min(root[a], root[b])
    assert [x[2] for x in got(ngram_join.ngram_jaccard_join(df, 3, 90))] == root


def test_ngram_join_of_rows_without_an_id(spark):
    base = " ".join("w%d" % i for i in range(80))
    near = base + " end"
    rows = [(None, base), (4, near), (2, base + " end stop"), (None, "only one without id here"), (None, "only one without id here"), (None, None), (9, "")]
    found = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    by = collections.defaultdict(list)
    for r in found:
        by[r["n_shingles"]].append((r["doc_id"], r["component_id"]))
    assert by[78] == [(None, 2)] and by[79] == [(4, 2)] and by[80] == [(2, 2)]
    assert len(by[3]) == 2 and len({x[1] for x in by[3]}) == 1 and by[3][0][0] is None
    assert sorted(by[0], key=str) == [(9, 9), (None, None)]


def test_folded_rows_bound_differences():

    import numpy as np

    r = random.Random(1)
    sets = [np.unique(np.array([r.getrandbits(64) for _ in range(n)], np.uint64)) for n in (0, 1, 5, 300, 2000)]
    sets.append(np.unique(np.concatenate([sets[3][:280], sets[2]])))
    rows = ngram_join.folded(sets)
    bits = np.unpackbits(rows.view(np.uint8), axis=1)
    for a in range(len(sets)):
        for b in range(len(sets)):
            assert (bits[a] ^ bits[b]).sum() <= len(np.setxor1d(sets[a], sets[b]))
    assert 15 <= (bits[3] ^ bits[5]).sum() <= 25


def test_pii(docs, rows):
    tagger = pii.train(pii.labelled_texts(200))
    found = pii.find_pii(docs, tagger)
    want = []
    for r in rows:
        spans = base_spans(r[1] or "")
        want.append((r[0], *(sum(s[0] == k for s in spans) for k in pii.KINDS), sha(",".join("%s:%d:%d" % s for s in spans))))
    assert got(found, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want)
    assert all(n == len([x for x in spans.split(",") if x]) for spans, n in got(found, "spans", "n_spans"))


def base_spans(text):
    """The contract's patterns, as they stand."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for kind, pattern in (("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            total = sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d)))
            if (13 <= len(d) <= 19 and total % 10 == 0) if kind == "card" else 9 <= len(d) <= 15:
                out.append((kind, *m.span()))
    return out


@pytest.mark.parametrize("text", [
    "a@b.c.d, x@@y.z q@r", "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.1", "4111 1111-1111 1111 and 41111111111111112", "+44 (0)20 7946 0958 +1--2", "a@b.c@d.e", "12.34.56.78.90", "..@a.b", "+1234567 +12345678 90", "é" * 3 + " a.b@c.de",
])
def test_pii_rules(text):
    assert pii.rule_spans(text) == base_spans(text)


@pytest.fixture(scope="module")
def tagger():
    return pii.default_tagger()


def test_pii_learns(tagger):
    """Windows that were not used for any choice, in prose: recall by kind and precision of what the network alone finds."""
    right, total, found = collections.Counter(), collections.Counter(), 0
    before = "plain words here and " * 3
    test = pii.labelled_texts(800, seed=4321)
    texts = [before + t + " and so on it goes" for t, _ in test]
    for (text, spans), got_ in zip(test, pii.added_spans(texts, [[] for _ in texts], tagger), strict=True):
        whole = {(k, a + len(before), b + len(before)) for k, a, b in spans if a > 0 and b < len(text)}
        cut = [(a + len(before), b + len(before)) for _, a, b in spans if a == 0 or b == len(text)]
        got_ = {x for x in got_ if not any(x[1] < b and a < x[2] for a, b in cut)}
        right.update(k for k, _, _ in whole & got_)
        total.update(k for k, _, _ in whole)
        found += len(got_)
    print({k: round(right[k] / total[k], 3) for k in pii.KINDS}, right.total() / total.total(), right.total() / found)
    assert all(right[k] >= 0.9 * total[k] for k in pii.KINDS) and right.total() >= 0.95 * found


def test_pii_adds_what_rules_miss(spark, tagger):
    """A planted table: base spans stay, forms that rules miss are added, clean rows have none."""
    forms = ["ann.miller at shop dot com", "john at example.com", "info AT firm.org", "lee[at]mail[dot]org", "4111.1111.1111.1111", "4111/1111/1111/1111", "(555) 010-1234", "212-555-0188", "10 dot 20 dot 30 dot 40", "10[.]2[.]3[.]4"]
    prose = "the man of the house was there with us and then for all the days "
    rows = [(i, prose * (1 + i % 30) + "call or write " + f + " for more of it. " + prose + "a@b.cd", "clash") for i, f in enumerate(forms * 4)]
    clean = ["paid on 2024-05-06 at noon", "token = \"" + "9f8e7d6c5b" * 4 + "\"", "number 4283063954042639 here", "version 2.0, Apache License", "meet at the dot of ten", prose * 400]
    rows += [(100 + i, prose + x + " " + prose, "clash") for i, x in enumerate(clean)] + [(200, None, ""), (201, "", "")]
    found = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string, spans string"), tagger).collect()}
    caught = 0
    for i, text, _ in rows[: len(forms) * 4]:
        spans = [x.split(":") for x in found[i]["spans"].split(",")]
        assert ["email", str(len(text) - 6), str(len(text))] in spans
        form = forms[i % len(forms)]
        at = text.index(form)
        caught += any(int(a) < at + len(form) and at < int(b) for _, a, b in spans)
    assert caught >= 0.9 * len(forms) * 4
    assert sum(found[i]["spans"] != "" for i in range(100, 100 + len(clean))) <= 1 and found[200]["spans"] == found[201]["spans"] == ""


def test_pii_scores_do_not_depend_on_where_windows_lie(tagger):
    """Long texts are read in windows; away from their edges the scores agree with those of one long window."""
    import numpy as np

    text = ("words and words " * 60 + "write to lee at shop dot com ") * 3
    codes = pii.encode_window(text)
    several = tagger.scores(codes, np.array([0, len(codes)]))
    ahead, back = tagger._window_scores(codes, np.array([0]), np.array([len(codes)]))
    one = ahead[0] + back[0][::-1] + tagger.p["out_b"]
    assert np.abs(several - one).max() < 0.5
    assert tagger.scores(codes[:0], np.array([0])).shape == (0, 9)


def test_line_dedup(docs, rows):
    """Windows of two lines with words, and single lines of fifty words: all but the first go."""
    seen, gone = set(), collections.defaultdict(set)
    for doc, text in sorted({(r[0], r[1]) for r in rows if r[1] is not None}):
        lines = [(i, x) for i, x in enumerate(text.split("\n")) if WORD.search(x)]
        for k, (i, x) in enumerate(lines):
            if len(WORD.findall(x)) >= 50:
                if x in seen:
                    gone[doc].add(i)
                seen.add(x)
            if k + 1 < len(lines):
                pair = (x, lines[k + 1][1])
                if pair in seen:
                    gone[doc] |= {i, lines[k + 1][0]}
                seen.add(pair)
    want = []
    for r in rows:
        parts = r[1].split("\n") if r[1] is not None else []
        cut = gone[r[0]]
        runs = sum(i - 1 not in cut for i in cut)
        want.append((r[0], len(parts), len(cut), runs, "\n".join(x for i, x in enumerate(parts) if i not in cut) if r[1] is not None else ""))
    found = [(a, b, c, d, e or "") for a, b, c, d, e in (tuple(r[x] for x in ("doc_id", "n_lines", "n_deleted", "n_runs", "text")) for r in line_dedup.line_dedup(docs).collect())]
    assert sorted(found) == sorted(want)


def test_line_fingerprints_are_fewer_than_lines_and_cover_every_window(spark):

    r = random.Random(5)
    rows = [(i, 0, i, "\n".join("line %d" % r.randrange(10**6) for _ in range(200))) for i in range(10)]
    for w in (2, 4, 8):
        hashed = line_dedup.line_hashes(spark.createDataFrame(rows, "r1 long, r2 long, doc_id long, text string"), 50)
        marks = line_dedup.fingerprints(hashed, w).collect()
        assert len(marks) < 10 * 200 * 2.3 / (w + 1)
        windows = collections.Counter((m["doc_id"], k) for m in marks for k in m["ks"])
        assert set(windows) == {(i, k) for i in range(10) for k in range(1, 200 - w + 2)} and set(windows.values()) == {1}


@pytest.mark.parametrize("w", [2, 5])
def test_a_run_of_lines_is_found_at_any_offset(spark, w):
    run = ["shared line %d" % k for k in range(w)]
    own = lambda i, n: ["own %d %d" % (i, k) for k in range(n)]
    texts = [own(i, i) + run + own(100 + i, 12 - i) for i in range(12)]
    df = spark.createDataFrame([(i, "\n".join(t), "x") for i, t in enumerate(texts)], "doc_id long, text string, lines string")
    found = {r["doc_id"]: r for r in line_dedup.line_dedup(df, w).collect()}
    assert found[0]["n_deleted"] == 0 and found[0]["text"] == "\n".join(texts[0])
    for i in range(1, 12):
        assert (found[i]["n_deleted"], found[i]["n_runs"]) == (w, 1)
        assert found[i]["text"] == "\n".join(x for x in texts[i] if x not in run)
    short = spark.createDataFrame([(i, "\n".join(own(i, 2) + run[: w - 1] + own(50 + i, 2))) for i in range(4)], "doc_id long, text string")
    assert all(r["n_deleted"] == 0 for r in line_dedup.line_dedup(short, w).collect())


def test_one_copy_of_a_run_stays_among_texts_without_an_id_or_of_one_id(spark):
    texts = [(None, "a b\nc d\n%s" % x) for x in ("x", "y", "z")] + [(4, "e f\ng h\n%s" % x) for x in ("x", "y")] + [(5, "k\nl")] * 2
    found = line_dedup.line_dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    for doc, copies in ((None, 3), (4, 2)):
        assert sorted(r["n_deleted"] for r in found if r["doc_id"] == doc) == [0] + [2] * (copies - 1)
    assert [r["text"] for r in found if r["doc_id"] == 5] == ["k\nl"] * 2  # a repeated row is one document


@pytest.mark.parametrize("w", [2, 3, 4])
def test_runs_of_lines_against_brute_force(spark, w):
    """Few different lines, so that a fingerprint stands in many surroundings and windows differ from the first."""
    r = random.Random(w)
    texts = ["\n".join("line %d" % r.randrange(6) for _ in range(r.randrange(14))) for _ in range(60)]
    lines = [t.split("\n") if t else [] for t in texts]
    first, want = {}, {}
    for i, t in enumerate(lines):
        gone = set()
        for k in range(len(t) - w + 1):
            if first.setdefault(tuple(t[k : k + w]), (i, k)) < (i, k):
                gone |= set(range(k, k + w))
        want[i] = "\n".join(x for k, x in enumerate(t) if k not in gone)
    found = line_dedup.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), w)
    assert {x["doc_id"]: x["text"] for x in found.collect()} == want


def test_line_dedup_keeps_columns_of_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b\nc d", "q", 1), (2, "a b\nc d\ne", "r", 2)], "doc_id long, text string, lines string, r1 int")
    found, name = line_dedup.rest_of_lines(df)
    assert name not in df.columns
    assert sorted((r["lines"], r["r1"], r[name]["rest"]) for r in found.collect()) == [("q", 1, "a b\nc d"), ("r", 2, "e")]


def test_decontaminate_reads_blocks_one_by_one(spark, monkeypatch):
    """Twenty blocks; the next is read when the one before has been searched, and a worker keeps one."""
    held, most, real = [], [], decontaminate.item_blocks

    def counted(*x):
        for block in real(*x):
            held.append(1)
            most.append(len(held))
            yield block
            held.pop()

    monkeypatch.setattr(decontaminate, "item_blocks", counted)
    words = [" ".join("w%dx%d" % (i, k) for k in range(15)) for i in range(20)]
    bench = spark.createDataFrame(list(enumerate(words)), "item_id long, text string")
    df = spark.createDataFrame([(1, words[3] + " x " + words[17], "a", 1), (1, "nothing", "b", 2)], "doc_id long, text string, found string, t1 int")
    found, name = decontaminate.search(df, bench, block_bytes=400)
    rows = {r["found"]: r for r in found.collect()}
    assert len(most) > 3 and max(most) == 1
    assert rows["a"][name]["n_items"] == 2 and rows["a"][name]["n_hit"] == 30 and rows["a"]["t1"] == 1 and not rows["b"][name]["contaminated"]
    for k in range(3):
        decontaminate.searcher_of(str(k), [("i", b"a b c")], 13)
    assert list(decontaminate._held) == ["2"]


@pytest.mark.parametrize("block_bytes", [8 << 20, 400])
def test_decontaminate(spark, docs, rows, block_bytes):
    long = rows[6][1]
    items = [(1, long[:300]), (2, "one two"), (3, None), (4, "..."), (5, long[:300]), (6, " ".join(rows[9][1].split()[40:53])), (10, "THREE four")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    want = []
    for r in rows:
        w, hit, names = words(r[1]), set(), set()
        for item, text in items:
            x = words(text)
            m = min(13, len(x))
            wins = {tuple(x[i : i + m]) for i in range(len(x) - m + 1)} if m else set()
            for i in range(len(w) - m + 1 if m else 0):
                if tuple(w[i : i + m]) in wins:
                    hit |= set(range(i, i + m))
                    names.add(str(item))
        want.append((r[0], len(w), len(hit), len(names), sha(",".join(sorted(names))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    assert got(decontaminate.decontaminate(docs, bench, block_bytes=block_bytes)) == sorted(want)


def test_classifier_separates(spark):
    rows = [(i, ("good fine prose flows " if i % 2 else "junk spam click buy ") * (3 + i % 5), 7) for i in range(300)] + [(1000, None, 7), (1001, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    known = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(5, None)], "doc_id long, quality int")
    found = classifier.quality_classifier(df, known).collect()
    assert len(found) == 302 and all(0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held_out"] and r["doc_id"] < 300]
    assert held and all((r["score"] > 0.5) == bool(r["doc_id"] % 2) for r in held)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in found)


def test_classifier_finds_a_rare_class_among_few_examples(spark):
    rows = [(i, "the of and a to " * 20 + ("good fine prose flows " if i % 7 else "junk spam click buy ") * (3 + i % 5)) for i in range(300)]
    known = spark.createDataFrame([(i, int(i % 7 > 0)) for i in range(300)], "doc_id long, quality int")
    found = classifier.quality_classifier(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 7 > 0) for r in found if r["held_out"])


def test_classifier_without_or_with_one_label(docs, spark):
    none = classifier.quality_classifier(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r["score"] for r in none} == {0.5}
    one = classifier.quality_classifier(docs, spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")).collect()
    assert all(r["score"] > 0.99 for r in one)


def test_token_counts(docs, rows):
    scores = token_counts.zipf_scores(token_counts.pieces_of(vocabulary(PIECES)))
    longest, unknown = max(map(len, scores)), min(scores.values()) - 10

    def best(word):
        s = "▁" + word
        at = [(0.0, 0)]
        for end in range(1, len(s) + 1):
            size = 1 if s[end - 1] == "▁" else len(s[end - 1].encode())
            ways = [(at[end - 1][0] + unknown * size, at[end - 1][1] - size)]
            ways += [(at[b][0] + scores[s[b:end]], at[b][1] - 1) for b in range(max(0, end - longest), end) if s[b:end] in scores]
            at.append(max(ways))
        return -at[-1][1]

    want = [(r[0], len(WORD.findall(r[1] or "")), sum(map(best, WORD.findall(r[1] or "")))) for r in rows]
    assert got(token_counts.token_counts(docs, scores)) == sorted(want)


def test_bpe_equals_the_library(docs, rows):
    from tokenizers import Tokenizer

    path = vocabulary(WORD_BPE)
    t = Tokenizer.from_file(path)
    t.no_truncation(), t.no_padding()
    want = []
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), ids, sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha(t.decode(ids, skip_special_tokens=False))))
    assert got(bpe.bpe_encode(docs, path)) == sorted(want)


@pytest.mark.parametrize("text", ["İstanbul ΣΑΣ ß ﬁ", "<|startoftext|>Hi<|endoftext|> <|x|>", "don't we'LL 1234 ½ á", "‍👩‍👩‍👧 日本語 \x00\x01", "a" * 300, "Ᲊ\U0001fae9 new", "  　x y "])
def test_bpe_of_odd_texts(text):
    from pathlib import Path

    from tokenizers import Tokenizer

    path = vocabulary(WORD_BPE)
    t = Tokenizer.from_file(path)
    t.no_truncation(), t.no_padding()
    ids = t.encode(text, add_special_tokens=False).ids
    raw, decoded = bpe.load(Path(path).read_text(encoding="utf-8")).encode(text)
    assert [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)] == ids
    assert decoded == t.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("size", [200, 30, 900])
def test_suffix_dedup(docs, rows, size):
    where = collections.Counter()
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    for _, b in data:
        for i in range(len(b) - size + 1):
            where[b[i : i + size]] += 1
    want = []
    for doc, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if where[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((doc, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    assert got(suffix_dedup.suffix_dedup(docs, size).drop("kept")) == sorted(want)


def test_suffix_dedup_refuses_sizes_without_room_for_an_anchor(docs):
    with pytest.raises(ValueError):
        suffix_dedup.suffix_dedup(docs, 7)


def test_loser_tree_merges():
    runs = [sorted(x) for x in ([b"a", b"abc", b"abd", b"b"], [b"", b"ab", b"abc"], [b"zz"])]
    coded = [iter(list(zip(*suffix_dedup.front_code(x), strict=True))) for x in runs] + [iter(())]
    out = list(suffix_dedup.merge_runs(coded))
    assert [x[1] for x in out] == sorted(sum(runs, []))
    assert all(x[0] == suffix_dedup.common_prefix(p[1], x[1]) for p, x in zip(out, out[1:]))


def test_quality_scores_do_not_depend_on_the_order_of_rows(spark):
    """Ids with two labels and two texts."""
    r = random.Random(8)
    texts = [(k % 40, " ".join(r.choice(("good", "fine", "text", "spam", "junk")) + str(r.randrange(9)) for _ in range(30))) for k in range(80)]
    marks = [(k % 40, (k * 7) % 3 % 2) for k in range(80)]
    scores = []
    for n in (1, 5):
        r.shuffle(texts)
        r.shuffle(marks)
        docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(n)
        found = classifier.quality_classifier(docs, spark.createDataFrame(marks, "doc_id long, quality int").repartition(6 - n))
        scores.append(sorted((x["doc_id"], x["score"]) for x in found.collect()))
    assert len(scores[0]) == 80 and scores[0] == scores[1]
