"""The operators against plain Python versions, on the small tables' documents and on odd rows."""

import collections
import zlib

import numpy as np
import pytest

import brute
from siltworks.llm import boosting, components, decontam, licenses, linededup, media, mixing, pii, quality, sharding, simhash, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard string, _row int"
LINE = "A line that several documents share, word for word."
PASSAGE = "one two three four five six seven eight nine ten eleven"
ODD = [
    None, "", "\n", " \t ", "word", "two words", f"{LINE}\n", f"x\n  {LINE.upper()}  \ny", f"{LINE}\n{LINE}\nend", f"\n{LINE}", "é" * 19 + "\n" + "é" * 20,
    PASSAGE, f"before {PASSAGE.upper()} after", PASSAGE.replace(" ", ", "), "Solo", "alpha beta SHORT item gamma",
    "MIT License mit license", "gnu general public license version 3 or later; CC BY-NC 4.0", "Licensed under the Apache License, Version 2.0.",
    "a@b.co a@b.co_d@e.fg x@y", "1.2.3.4.5.6.7.8 300.1.1.1 0001.02.3.255", "4111 1111 1111 1111, 4111-1111-1111-1112 4111  1111", "+1 (234) 555-6789 +123 +1234567890123456 +12 3456 789)",
    "mail bob [at] site dot com or tel (020) 555-1234", "1" * 3000, "a" * 40_000 + "@", "1-" * 5000, "w " * 30_000, "😀 a@b.cd 😀",
]


@pytest.fixture(scope="module")
def rows(spark):
    real = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(120).collect()]
    odd = [(10_000 + i, t) for i, t in enumerate(ODD)]
    return [*real, *odd, *odd[4:9], (None, f"{LINE}\nnull id"), (None, None), *((20_000 + i, real[3][1]) for i in range(3))]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, None if k % 5 else "en", f"s{k % 3}" if k % 7 else None, None, 0.1, "x", 1) for k, (i, t) in enumerate(rows)], SCHEMA).repartition(7).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(frame, columns, wanted):
    got = [tuple(r) for r in frame.select(*columns).collect()]
    assert collections.Counter(got) == collections.Counter(wanted)


def test_line_dedup(docs, rows):
    same(linededup.dedup_lines(docs), ("doc_id", "n_lines", "n_dropped", "kept_sha256"), brute.line_dedup(rows))


def test_simhash(docs, rows):
    prints = [brute.fingerprint(t) for _, t in rows]
    smallest = brute.components([i for i, _ in rows], prints, 3)
    same(simhash.near_duplicates(docs), ("doc_id", "fingerprint", "component_id"), [(i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, smallest, strict=True)])


@pytest.mark.parametrize("radius", [3, 11])
def test_links_are_complete_where_keys_are_split(spark, monkeypatch, radius):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 40)
    prints = sorted({int(c) ^ sum({1 << int(b) for b in rng.integers(0, 63, int(rng.integers(0, radius + 2)))}) for c in np.concatenate([centres, np.repeat(centres[:2], 150)])})
    out = simhash.link_rows(spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "id long, f0 long"), radius)
    assert [r[0] for r in out.orderBy("id").select("component").collect()] == brute.components(list(range(len(prints))), prints, radius)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 400)] + [(1000, 1001), (1001, 1001), (1001, 1000)]
    got = dict(map(tuple, components.stars(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(1, 401)}, 1001: 1000}


def test_keep_one_against_all_pairs(spark):
    """Of texts with one to twelve changed words: all similar ones go, and no other."""
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(60):
        base = [f"w{k}" for k in rng.integers(0, 5000, 220)]
        texts.append(base)
        for changes in (1, 3, 5, 8, 12):
            texts.append([f"x{rng.integers(0, 10**6)}" if k in at else w for at in [set(rng.choice(220, changes, replace=False).tolist())] for k, w in enumerate(base)])
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))
    for b in range(len(texts)):  # from small to large, so each root is the smallest of its component
        for a in range(b):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    must_go = {i for i, r in enumerate(root) if r != i}
    left = simhash.keep_one(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))
    gone = set(range(len(texts))) - {r[0] for r in left.collect()}
    assert gone == must_go


@pytest.mark.parametrize("most", [simhash.BLOCK_SHINGLES, 5000])
def test_near_duplicates_of_a_dense_family_are_exact(spark, monkeypatch, most):
    """A family of 70 variants around 0.8: what stays is what all pairs of exact similarities leave, in however many blocks."""
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", most)
    settled = []
    verify = simhash.settle
    monkeypatch.setattr(simhash, "settle", lambda crowded, *rest: settled.append(crowded.count()) or verify(crowded, *rest))
    rng = np.random.default_rng(3)
    base = [f"w{i * 7919 % 5003}" for i in range(400)]
    texts = []
    for i in range(70):
        own = list(base)
        for at in rng.choice(400, int(rng.integers(2, 11)), replace=False):
            own[at] = f"x{i}_{at}"
        texts.append((i, " ".join(own)))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in texts)]
    root = list(range(70))
    for i in range(70):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    left = simhash.keep_one(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(r[0] for r in left.collect()) == sorted(set(root)) and settled[0] > 0


def test_near_duplicates_keep_one(spark):
    base = " ".join(f"w{i * 7919 % 5003}" for i in range(400))
    near = base.replace("w7919 ", "other ").replace(" w2916 ", " changed ")
    texts = [(5, base), (3, near), (9, base), (9, base), (7, " ".join(f"v{i * 31 % 997}" for i in range(300))), (8, None), (4, "")]
    left = simhash.keep_one(spark.createDataFrame(texts, "doc_id long, text string"))
    assert left.columns == ["doc_id", "text"] and sorted(r[0] for r in left.collect()) == [3, 4, 7]


def test_pii_base_spans(docs, rows):
    wanted = []
    for i, t in rows:
        spans = brute.base_spans(t)
        wanted.append((i, *[sum(s[0] == k for s in spans) for k in pii.BASE], brute.sha(",".join(f"{k}:{s}:{e}" for k, s, e in spans))))
    found = pii.find(docs)
    same(found, ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"), wanted)
    held = {r[0]: r[1].split(",") for r in found.select("doc_id", "spans").collect() if r[0] is not None}
    assert all(f"{k}:{s}:{e}" in held[i] for i, t in rows if i is not None for k, s, e in brute.base_spans(t))
    assert any(s.startswith("email:") for s in held[10_000 + ODD.index("mail bob [at] site dot com or tel (020) 555-1234")])


def test_pii_redaction(spark):
    got = pii.redact(spark.createDataFrame([(1, "write a@b.cd now"), (2, "nothing"), (3, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r[1] for r in got] == ["write [email] now", "nothing", None]


def test_trees_in_sql_equal_trees_in_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 9, (400, 3)).astype(float)
    trees = boosting.fit(x, (x[:, 0] + x[:, 1] > 8).astype(float), trees=6)
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double").selectExpr(boosting.sql(trees, ["a", "b", "c"]) + " AS s")
    assert np.allclose([r[0] for r in df.collect()], boosting.logit(trees, x), atol=1e-6)


ITEMS = [(1, PASSAGE), (2, "short item"), (10, "SHORT, item!"), (3, None), (4, "..."), (5, "unseen " * 12), (1, PASSAGE)]


@pytest.mark.parametrize("most", [decontam.MAX_SET, 0])
def test_decontamination(spark, docs, rows, most):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    same(decontam.find(docs, items, max_set=most), ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"), brute.contamination(rows, ITEMS))


def test_decontamination_without_items(spark, docs):
    assert decontam.find(docs, spark.createDataFrame([], "item_id long, text string")).filter("contaminated").count() == 0


def test_removal_keeps_columns(spark, docs, rows):
    left = decontam.remove(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert left.columns == docs.columns and left.count() == sum(not x[-1] for x in brute.contamination(rows, ITEMS))


def test_licenses(docs, rows):
    same(licenses.scan(docs), ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"), [(i, *brute.licenses(t)) for i, t in rows])


def test_license_rules(spark):
    texts = ["gnu general public license version 3 or later", "Licensed under CC BY-NC-SA 4.0", "BSD 3-Clause", "the apache license, version 2.0", "a licence to thrill"]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").select("labels").collect()
    assert [r[0] for r in got] == ["gpl,gpl-3+", "cc-by,cc-by-nc-sa-4.0,unknown-license", "bsd-3", "apache,apache-2", ""]
    assert len(licenses.rules()) > 200


def test_sharding(docs, rows):
    out = sharding.shard_rows(docs)
    same(out, ("doc_id", "size", "text_crc32", "law", "shard", "grown_shard"), [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", brute.jump(i or 0, 8), brute.jump(i or 0, 9)) for i, t in rows])
    slots = collections.defaultdict(list)
    for r in out.select("shard", "slot").collect():
        slots[r[0]].append(r[1])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert out.filter("grown_shard <> shard AND grown_shard <> 8").count() == 0


def test_media(docs, rows):
    out = media.media_column(docs)
    same(out, ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"), [(i, *brute.media(t)) for i, t in rows])
    assert out.filter("n_shared > 0").count() and out.groupBy("payload_sha256").agg({"media_sha256": "max"}).count() == len({brute.media(t)[2] for _, t in rows})


def test_chunks_follow_the_content():
    data = np.random.default_rng(3).bytes(60_000)
    assert b"".join(media.chunks(data)) == data
    assert all(media.LEAST <= len(c) <= media.MOST for c in media.chunks(data)[:-1])
    assert len(set(media.chunks(data)) & set(media.chunks(b"inserted" + data))) > 0.8 * len(media.chunks(data))
    with pytest.raises(ValueError):
        media._read(1, 1, "0" * 64, 1, 0, media.encode(b"x" * 576))


def test_mixing(docs, rows, monkeypatch):
    monkeypatch.setattr(mixing, "SWEEPS", 2)
    out = mixing.mix(docs)
    assert out.count() == len(rows) and out.filter("probability IS NULL OR probability > 1").count() == 0
    a = {tuple(r) for r in out.select("doc_id", "weight", "probability").collect()}
    b = {tuple(r) for r in mixing.mix(docs, max_cells=0).select("doc_id", "weight", "probability").collect()}
    key = lambda x: (x[0] is None, x[0], x[1])
    for x, y in zip(sorted(a, key=str), sorted(b, key=str), strict=True):
        assert x[0] == y[0]
        assert x[1:] == pytest.approx(y[1:], rel=1e-3, abs=1e-6)


def test_raking_meets_the_marginals():
    cells = {(s, lang, t): float(1 + 3 * i + 5 * j + 7 * k) for i, s in enumerate("abc") for j, lang in enumerate("xy") for k, t in enumerate("pq")}
    targets = [{"a": 0.2, "b": 0.3, "c": 0.5}, {"x": 0.6, "y": 0.4}, {"p": 0.5, "q": 0.5}]
    weights, total = mixing.rake(cells, targets), sum(cells.values())
    for d, target in enumerate(targets):
        for value, share in target.items():
            assert sum(cells[c] * weights[c] for c in cells if c[d] == value) / total == pytest.approx(share, rel=1e-6)


@pytest.mark.parametrize("kind", [quality, toxicity])
def test_classifiers_on_held_out_rows(spark, kind):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    label = "quality" if kind is quality else "toxic"
    got = kind.classify(docs, labels).join(labels, "doc_id").filter("held_out").select("score", label).collect()
    good, bad = [r[0] for r in got if r[1] == 1], [r[0] for r in got if r[1] == 0]
    ranked = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert ranked > (0.99 if kind is quality else 0.8)


@pytest.mark.parametrize("kind", [quality, toxicity])
def test_classifiers_on_odd_rows(spark, docs, rows, kind):
    labels = spark.createDataFrame([(i, k % 2, k % 3 and 1) for k, (i, _) in enumerate(rows) if i is not None], "doc_id long, quality int, toxic int")
    out = kind.classify(docs, labels)
    assert out.count() == len(rows) and out.filter("score IS NULL OR score < 0 OR score > 1 OR held_out IS NULL").count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {round(r[0], 6) for r in kind.classify(docs, none).select("score").collect()} == {0.5}


def test_empty_tables(spark, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    made = [
        quality.classify(empty, labels), media.media_column(empty), toxicity.classify(empty, labels), linededup.dedup_lines(empty), simhash.near_duplicates(empty), simhash.keep_one(empty),
        pii.find(empty), decontam.find(empty, items), licenses.scan(empty), mixing.mix(empty), sharding.shard_rows(empty),
    ]
    assert [x.count() for x in made] == [0] * len(made)


def test_many_spans_in_one_text(spark):
    """Thousands of spans and candidates: all base spans, and of what overlaps only one stays."""
    text = " ".join(f'u{i}@site{i}.org token = "{i:040x}" call 555-123-{i:04d} now' for i in range(1500))
    row = pii.find(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")).collect()[0]
    base = brute.base_spans(text)
    assert row.n_email == 1500 and row.base_sha256 == brute.sha(",".join(f"{k}:{s}:{e}" for k, s, e in base))
    spans = sorted((x.s, x.e) for x in row.found)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)) and sum(x.kind == "secret" for x in row.found) > 1000


def test_columns_to_keep_may_have_any_name(spark):
    names = ["size", "text_crc32", "law", "shard", "slot", "grown_shard", "_at", "_part", "n_words", "n_hit", "spans", "contaminated", "_text", "_doc"]
    docs = spark.createDataFrame([(i, f"text {i % 3}", *[f"{n}{i}" for n in names]) for i in range(20)] * 2, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = sharding.shard_rows(docs, keep=("text", *names))
    assert out.select("doc_id", "text", *names).exceptAll(docs).count() == 0 and out.count() == 40
    assert sorted(r[0] for r in out.select("slot_").distinct().collect()) == list(range(out.groupBy("shard_").count().agg({"count": "max"}).first()[0]))
    found = decontam.find(docs, spark.createDataFrame([(1, "text 1")], "item_id long, text string"), keep=tuple(names))
    assert found.select("doc_id", *names).exceptAll(docs.drop("text")).count() == 0 and found.filter("contaminated_").count() == 14
    assert decontam.remove(docs, spark.createDataFrame([(1, "text 1")], "item_id long, text string")).columns == docs.columns


def test_samples_count_repeated_and_missing_documents_once(spark):
    from siltworks.llm import sampling

    docs = spark.createDataFrame([(1, "b text"), (1, "a text")] * 2000 + [(i, f"text {i}") for i in range(2, 40)] + [(99, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(1, None), (1, 1), (1, 0)], "doc_id long, quality int")
    rows = sampling.labelled_features(docs, labels, "quality", (4, 2), 12, lambda t: t.encode())
    wanted = [i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(rows) == sum(min(12, sum((i % 2 if i != 1 else 0) == c for i in wanted)) for c in (0, 1))
    assert sum(b in (b"a text", b"b text") for _, b in rows) <= 1
    assert len(sampling.labelled_features(docs, labels, "quality", (4, 2), 12, lambda t: t.encode(), 80)) < len(rows)


def test_stated_targets(spark):
    """Named values get their shares, the others share the rest; the driver's and the tables' way agree."""
    targets = {"lang": {"en": 0.5, "xx": 0.2}, "source": {"s1": 0.4}}
    docs = spark.createDataFrame([(i, "w " * (5 + i % 11) + ("a | b" if i % 4 == 0 else ""), ["en", "de", "fr"][i % 3], f"s{i % 5}") for i in range(600)], "doc_id long, text string, lang string, source string")
    for most in (mixing.MAX_CELLS, 0):
        rows = mixing.mix(docs, targets, fraction=0.5, max_cells=most).select("lang", "source", "tokens", "probability").collect()
        total = sum(r.tokens * r.probability for r in rows)
        share = lambda k, v: sum(r.tokens * r.probability for r in rows if r[k] == v) / total  # noqa: B023, E731
        assert share("lang", "en") == pytest.approx(0.5, rel=1e-3) and share("source", "s1") == pytest.approx(0.4, rel=1e-3)
        assert share("lang", "de") + share("lang", "fr") == pytest.approx(0.5, rel=1e-3)


def test_hot_keys_of_aggregates_can_be_split(spark):
    """A join with respread() has an exchange of its own on the aggregate's side, without which Spark can't split the other."""
    from siltworks.llm.common import respread

    rows = spark.range(1000).selectExpr("id % 7 AS k", "id AS v")
    for key in ("k", "cast(cast(k AS string) AS binary)"):
        keyed = rows.selectExpr(f"{key} AS k", "v")
        least = keyed.groupBy("k").agg({"v": "min"})
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        plain, spread = keyed.hint("merge").join(least, "k"), keyed.hint("merge").join(respread(least, "k"), "k")
        assert plan(spread).count("ENSURE_REQUIREMENTS") == plan(plain).count("ENSURE_REQUIREMENTS") + 1
        assert spread.count() == plain.count() == 1000


def test_bits(spark):
    from siltworks.llm.common import get_bits, set_bits

    bits, at = np.zeros(16, np.uint8), np.array([0, 3, 3, 127, 64])
    set_bits(bits, at)
    assert np.flatnonzero(np.unpackbits(bits)).tolist() == [0, 3, 64, 127] and np.flatnonzero(get_bits(bits, np.arange(128))).tolist() == [0, 3, 64, 127]
