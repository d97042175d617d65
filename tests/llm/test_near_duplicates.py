"""The filtering near-duplicate stage against all pairs by exact Jaccard similarity."""

import sys
import zlib

import numpy as np
import pytest
import xxhash

from siltworks.llm import sampling, simhash


def exact_left(texts, share=0.8):
    """doc_ids that stay if every pair is compared by its distinct five-word shingles."""
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.split() for _, t in texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    return {min(texts[i][0] for i in range(len(texts)) if root[i] == r) for r in set(root)}


def left(spark, texts):
    return {r[0] for r in simhash.keep_one(spark.createDataFrame(texts, "doc_id long, text string")).collect()}


def mixed_texts():
    """Repeated lines and words over unrelated texts, short texts and their extensions, spread changes, repeated lines."""
    rng, texts = np.random.default_rng(11), []
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    line, word = fresh(12), fresh(1)
    for _ in range(20):  # similarity next to 0
        texts += [line * 25 + fresh(300), word * 300 + fresh(300)]
    for _ in range(20):
        short, long, page = fresh(8), fresh(24), fresh(454)
        changed = list(page)
        for k in range(10):
            changed[20 + 45 * k] = "changed" + str(len(texts))
        texts += [short, short + fresh(1), long, long + fresh(5), page, changed]  # just 0.8, each
        body, last = fresh(200), fresh(12)
        texts += [body + last, body + last * 20]
        texts += [short[:3], [], fresh(4)]
    order = rng.permutation(len(texts))
    return [(int(i), " ".join(texts[k])) for i, k in enumerate(order)]


def test_keep_one_is_exact_on_repeats_and_short_texts(spark):
    texts = mixed_texts()
    assert left(spark, texts) == exact_left(texts)


def test_keep_one_is_exact_on_a_boilerplate_family(spark, monkeypatch):
    """Documents that share much less or a little less than 0.8 meet in many bands and must all stay; near copies go."""
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", 2000)
    rng = np.random.default_rng(12)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    shared = fresh(150)
    texts = [(i, " ".join(shared + fresh(int(rng.integers(8, 60))))) for i in range(60)]
    texts += [(100 + i, t + " " + " ".join(fresh(int(rng.integers(1, 12))))) for i, t in texts[:25]]
    assert left(spark, texts) == exact_left(texts)


def test_fingerprints_alone_bring_near_copies_together(spark):
    """Without bands, nodes within the radius are linked if they are similar; those of other texts are not."""
    rng = np.random.default_rng(13)
    texts = []
    for _ in range(12):
        page = [f"w{x}" for x in rng.integers(0, 10**9, 600)]
        texts += [page, [*page[:-1], "changed"], page * 2]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").cache()
    made = simhash.banded(docs).collect()
    for r, t in zip(sorted(made), texts, strict=True):
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in {" ".join(t[k : k + 5]) for k in range(len(t) - 4)}]
        assert r.f0 % (1 << 64) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    nodes = spark.createDataFrame([(r.node, (r.doc_id, r.row), r.f0, []) for r in made], "node long, first struct<doc_id: long, row: long>, f0 long, bands array<long>")
    near = {tuple(sorted((a.node, b.node))) for a in made for b in made if a.node != b.node and ((a.f0 ^ b.f0) % (1 << 64)).bit_count() <= simhash.KEEP_RADIUS}
    roots = dict(map(tuple, simhash.connect(nodes, docs).collect()))
    assert len(near) > 12 and all(roots.get(a, a) == roots.get(b, b) for a, b in near)
    assert len({roots.get(r.node, r.node) for r in made}) >= 12


def test_rows_are_counted_by_the_jobs_that_make_them(spark, monkeypatch):
    """The driver keeps every query's plan and tasks: of the counts only those of sweeps and repeated rows are queries of their own."""
    texts = mixed_texts()
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    own, real = [], type(docs).count
    monkeypatch.setattr(type(docs), "count", lambda df: own.append(sys._getframe(1).f_code.co_name) or real(df))
    assert {r[0] for r in simhash.keep_one(docs).collect()} == exact_left(texts)
    assert set(own) <= {"settled", "keep_one"}


def test_a_sample_comes_to_the_driver_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i} " * 9) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    whole = lambda df: pytest.fail("the sample was collected at once")
    monkeypatch.setattr(type(docs), "collect", whole)
    got = sampling.labelled_features(docs, labels, "quality", (4, 2), 40, str.encode)
    kept = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sorted(got) == sorted((i % 2, f"text {i} ".encode() * 9) for i in kept)
