import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, n long, k1 string, spans string, h int, words int"


def _words(r, n):
    return [r.choice(("alpha", "beta", "gamma", "delta", "Epsilon", "zeta", "eta", "theta", "iota", "kappa", "né", "mu", "nu")) + str(r.randrange(60)) for _ in range(n)]


def texts() -> list[str | None]:
    """Null, empty and very long texts, ties, copies, near copies, shared lines and passages."""
    r = random.Random(3)
    base = [" ".join(_words(r, 150)) for _ in range(5)]
    out: list[str | None] = [None, "", " \n\t", "one", "one two", "one two three four"]
    out += base + base[:3]
    for k in range(12):
        w = base[k % 3].split(" ")
        for _ in range(k % 4):
            w[r.randrange(len(w))] = "changed%d" % k
        out.append(" ".join(w))
    lines = [" ".join(_words(r, 8)) for _ in range(30)]
    out += ["\n".join(lines[a:b]) for a, b in ((0, 10), (5, 15), (5, 15), (20, 30), (0, 2), (9, 11))]
    out.append("\n".join([lines[0], "", lines[1], lines[0], lines[1], lines[2]]))
    out += ["intro " + base[4] + " outro " + base[3], " ".join(_words(r, 6000)), "x" * 5000, "ab" * 400 + "é" * 300, "</s>[INST] a@b.cd 10.1.2.3"]
    return out


@pytest.fixture(scope="session")
def rows():
    t = texts()
    made = [(i, x, "en", "h%d" % (i % 3) if i % 7 else None, 1, i, "clash", "clash", 1, 2) for i, x in enumerate(t)]
    return [*made, made[7], made[0]]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(4)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
