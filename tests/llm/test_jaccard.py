"""The join on rare shingles against all pairs."""

import functools
import random
import re

import pyarrow as pa
import pytest

from siltworks.llm import jaccard


def shingles(text, size=5):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    of = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and of[i] != of[j]:
                old, new = of[i], of[j]
                of = [new if x == old else x for x in of]
    least = {}
    for (d, _), root in zip(rows, of, strict=True):
        least[root] = d if least.get(root) is None else least[root] if d is None else min(least[root], d)
    return sorted(((d, len(s), least[root] if s else d) for (d, _), s, root in zip(rows, sets, of, strict=True)), key=str)


def found(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, shingle string").repartition(4)
    return sorted(map(tuple, jaccard.near_duplicates(docs).collect()), key=str)


def family(rnd, n, words, changes):
    base = [f"w{rnd.randrange(400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        one = list(base)
        for _ in range(rnd.randrange(changes + 1)):
            one[rnd.randrange(len(one))] = f"x{rnd.randrange(10**6)}"
        out.append(" ".join(one))
    return out


@pytest.mark.parametrize("small", [32, 2])
def test_classes_against_all_pairs(spark, monkeypatch, small):
    """small = 2: all families of three and more go by their smallest and largest nodes and through blocks."""
    monkeypatch.setattr(jaccard, "candidates", functools.partial(jaccard.candidates, small=small))
    rnd = random.Random(small)
    texts = [t for n, words, changes in ((12, 60, 3), (9, 200, 9), (8, 30, 2), (6, 120, 4)) for t in family(rnd, n, words, changes)]
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [passage + " " + " ".join(f"u{i}.{k}" for i in range(w)) for k, w in enumerate((4, 6, 8, 9, 10, 11, 12, 60, 200))]
    texts += [texts[0], texts[0].upper(), texts[0].replace(" ", "\n\t"), None, "", " \n", "one", "ONE", "a b c d", "a b c d", "a b c d e", "same " * 50, "same " * 51, "é É", "a b c d e f g h i", "a b c d e f g h i j"]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(None, texts[1]), (None, "only null"), (3, "twice"), (3, "twice"), (3, "thrice")]
    assert found(spark, rows) == brute(rows)


def test_shares_at_the_edge(spark):
    """8 of 10 shingles in common link, 15 of 19 don't."""
    a = [f"w{i}" for i in range(13)]
    rows = [(1, " ".join(a[:12])), (2, " ".join([*a[:12], "x", "y"]))]
    b = [f"v{i}" for i in range(19)]
    rows += [(3, " ".join(b)), (4, " ".join([*b, "x", "y", "z", "t"]))]
    assert [len(shingles(t)) for _, t in rows] == [8, 10, 15, 19] and found(spark, rows) == brute(rows) == [(1, 8, 1), (2, 10, 1), (3, 15, 3), (4, 19, 4)]


def test_very_long_text_and_no_rows(spark):
    long = " ".join(f"w{i % 5000} z{i}" for i in range(60_000))
    rows = [(5, long), (2, long + " end"), (9, long[: len(long) // 2])]
    assert [r[2] for r in found(spark, rows)] == [2, 2, 9]
    assert found(spark, []) == []


def test_hashes_of_words_in_bulk_equal_those_of_single_texts():
    texts = [None, "", "a", "A b", "x y  z\tw\nv u é É", " lead trail ", "q" * 300_000 + " b c d e f", "\xa0a b", "x" * 10 + " " + "y" * 600_000]
    bulk = [x.tolist() for x in jaccard.shingle_sets(pa.array(texts), 5)]
    single = [next(jaccard.shingle_sets(pa.array([t], pa.string()), 5)).tolist() for t in texts]
    sliced = [x.tolist() for x in jaccard.shingle_sets(pa.array(["skipped", *texts]).slice(1), 5)]
    assert bulk == single == sliced and [len(x) for x in bulk] == [len(shingles(t)) for t in texts]


def test_wide_rows_are_shuffled_once_before_they_meet(spark, monkeypatch):
    """Candidates whose lookups are too large to broadcast: each shuffle by the shingle is made once and used again."""
    made, real = [], jaccard.checkpointed

    def recorded(df):
        out = real(df)
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        made.append(len(re.findall(r"(?<!Reused)Exchange hashpartitioning\(shingle", plan)))
        return out

    monkeypatch.setattr(jaccard, "checkpointed", recorded)
    monkeypatch.setattr(jaccard, "few", lambda df: df)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = list(enumerate(family(random.Random(4), 40, 80, 3) + family(random.Random(5), 5, 80, 3)))
        assert found(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sum(made) <= 7, made


def test_copies_are_sent_once_and_the_lookup_is_made_once(spark, monkeypatch):
    """Copies lie in several tasks; the lookup is too large to broadcast."""
    sent, plans, real, candidates = [], [], jaccard.checkpointed, jaccard.candidates

    def recorded(df):
        out = real(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        return out

    monkeypatch.setattr(jaccard, "candidates", lambda rows, *a: sent.append(rows) or candidates(rows, *a))
    monkeypatch.setattr(jaccard, "checkpointed", recorded)
    monkeypatch.setattr(jaccard, "few", lambda df: df)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = list(enumerate(family(random.Random(6), 6, 60, 3) * 20))
        assert found(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sent[0].count() == sent[0].dropDuplicates(["shingle", "node"]).count()
    assert max(len(re.findall(r"Join \[shingle#\d+L\]", p)) for p in plans) == 1
