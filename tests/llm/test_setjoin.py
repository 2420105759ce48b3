"""The Jaccard join against all pairs of word-shingle sets."""

import random

import pytest

from tidemark.llm import setjoin


def shingles(text, k):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k, num, den, links=False):
    sets = [(i, shingles(t, k)) for i, t in rows]
    head = {i: i for i, _ in rows}
    count = dict.fromkeys(head, 0)

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and den * len(x & y) >= num * len(x | y):
                count[i] += 1
                count[j] += 1
                low, high = sorted((root(i), root(j)))
                head[high] = low
    return sorted((i, len(s), root(i), *([count[i]] if links else [])) for i, s in sets)


def joined(spark, rows, *rule):
    docs = setjoin.jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string"), *rule)
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in docs.collect())


def corpus(seed, n=160, near=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(n)]
    base = rng.choices(words, k=90)
    for _ in range(near):  # a crowd of near copies around one text
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 500)}"
        rows.append(" ".join(copy))
    rows += ["", None, "a", "a", "A", "a b", "B a", "\t\x0b ", "a b c", rows[3], rows[3].upper() if rows[3] else ""]
    return list(enumerate(rows))


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 80, 100), (1, 50, 100)])
def test_against_all_pairs(spark, k, num, den):
    rows = corpus(k)
    assert joined(spark, rows, k, num, den) == brute(rows, k, num, den, links=True)


@pytest.mark.parametrize("crowd", [2, 10**6])
def test_long_lists_and_crowds(spark, monkeypatch, crowd):
    """With small bounds every list is long and a crowd has many blocks; and without any crowd."""
    for name, value in (("LIST_ENTRIES", 16), ("GROUP_BLOCK", 8), ("HOT", 3), ("DENSE", 0), ("CROWD", crowd)):
        monkeypatch.setattr(setjoin, name, value)
    rows = corpus(9, 80, 90)
    assert joined(spark, rows, 3, 90, 100) == brute(rows, 3, 90, 100, links=True)


def test_words_that_a_polynomial_confuses(spark):
    a = "x"
    for _ in range(11):
        a += a.translate({120: 121, 121: 120})
    b = a.translate({120: 121, 121: 120})
    assert joined(spark, [(1, a), (2, b), (3, "abcdefgh"), (4, "abcdefg"), (5, "abcdefgh\0")], 3, 90, 100) == [(i, 1, i, 0) for i in range(1, 6)]


def test_very_long_texts(spark):
    rng = random.Random(6)
    long = [f"v{rng.randint(0, 10**6)}" for _ in range(60_000)]
    other = [w if rng.random() > 0.01 else "z" for w in long]
    got = joined(spark, [(1, " ".join(long)), (2, " ".join(other)), (3, " ".join(long[:30_000])), (4, "y" * 500_000)], 3, 90, 100)
    assert [(i, c, n) for i, _, c, n in got] == [(1, 1, 1), (2, 1, 1), (3, 3, 0), (4, 4, 0)]


def test_odd_rows(spark):
    kind = "doc_id bigint, text string, id string, n int, rep int, prefix string, component_id string"
    more = ("x", 1, 2, "y", "z")
    rows = [(None, "a b c d", *more), (7, "a b c d", *more), (7, "a b c d", *more), (5, "a b c d", *more), (9, None, None, None, None, None, None)]
    docs = setjoin.jaccard_join(spark.createDataFrame(rows, kind), 3, 90, 100)
    got = sorted(map(tuple, docs.collect()), key=str)
    assert got == sorted([(None, 2, None, None, 0), (7, 2, 5, 5, 1), (7, 2, 5, 5, 1), (5, 2, 5, 5, 1), (9, 0, 9, 9, 0)], key=str)


def test_empty_table(spark):
    assert setjoin.jaccard_join(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_rule():
    rule = setjoin.Rule(90, 100)
    for nx in range(1, 60):
        for ny in range(1, nx + 1):
            least = next(o for o in range(0, 200) if 100 * o >= 90 * (nx + ny - o))
            assert rule.overlap(nx, ny) == least
    assert rule.smallest(10) == 9 and rule.prefix(10) == 2
