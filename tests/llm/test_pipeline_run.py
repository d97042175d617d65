"""run() as a whole against plain Python versions of its stages, and on odd tables."""

import collections
import re

import pytest
import xxhash

import brute
import corpus_pipeline
from siltworks.llm import mixing, quality

CLASHES = ["size", "text_crc32", "law", "shard", "slot", "grown_shard", "topic", "tokens", "weight", "probability", "selected", "_u", "_source", "_lang", "_quality", "_text_hash", "_doc", "_gone_doc", "_gone_row", "bucket", "rank", "score", "hash", "node", "component"]
MADE = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
SF = "/root/testdata/sf0.001"


def write(spark, folder, docs, labels=None, items=None):
    docs.write.parquet(f"{folder}/documents.parquet")
    (labels or spark.read.parquet(f"{SF}/labels.parquet")).write.parquet(f"{folder}/labels.parquet")
    (items or spark.read.parquet(f"{SF}/benchmark.parquet")).write.parquet(f"{folder}/benchmark.parquet")
    return folder


def one_of_each(rows):
    """Rows (doc_id, text, ...) without all but the smallest doc_id of each group linked by similarity 0.8 of five-word shingles."""
    sets = []
    for r in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (r[1] or "").translate(brute.LOW)) if x]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    return [min((rows[i] for i in range(len(rows)) if root[i] == x), key=lambda r: r[0]) for x in sorted(set(root))]


def drawn(rows):
    """What the mixture draws of rows (doc_id, text, source, lang)."""
    key = lambda r: (r[2] or "", r[3] or "", next((name for name, p in mixing.TOPICS if re.search(p, r[1] or "")), "prose"))
    cells = collections.Counter()
    for r in rows:
        cells[key(r)] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    goal = []
    for d, name in enumerate(mixing.DIMENSIONS):
        sums = collections.Counter()
        for c, n in cells.items():
            sums[c[d]] += n
        goal.append(mixing.shares(sums, corpus_pipeline.TARGETS.get(name, {}), corpus_pipeline.POWER))
    c, weights = mixing.fit({k: float(v) for k, v in cells.items()}, goal, corpus_pipeline.FRACTION)
    out = []
    for r in rows:
        h = xxhash.xxh64_intdigest((r[1] or "").encode(), xxhash.xxh64_intdigest(r[0].to_bytes(8, "little", signed=True), 42))
        k = key(r)
        if not cells[k] or (h >> 11) / (1 << 53) < c * weights[k]:
            out.append(r)
    return out


def test_run_against_plain_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder = write(spark, str(tmp_path / "in"), docs)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source", "lang").orderBy("doc_id").collect()]
    good = {r[0] for r in quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter(f"score >= {corpus_pipeline.QUALITY}").select("doc_id").collect()}
    rows = one_of_each([r for r in rows if r[0] in good])
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {x[0] for x in brute.contamination([r[:2] for r in rows], items) if x[-1]}
    want = {r[0]: brute.jump(r[0], 8) for r in drawn([r for r in rows if r[0] not in bad])}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id: r.shard for r in got} == want and len(got) == len(want) > 20 and bad
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_leaves_clashing_columns_and_odd_rows_alone(spark, tmp_path):
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in base]
    rows += [(9001, None, None, None, None), (9002, "", "en", None, 0), (None, "a text without an id that nobody has seen before", "en", "s", 5), (9003, "long " * 60_000, "en", "s", None)] + rows[:5] * 3
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    docs = spark.createDataFrame([(*r, *[f"{c} {r[0]}" for c in CLASHES]) for r in rows], schema)
    out = corpus_pipeline.run(spark, write(spark, str(tmp_path / "in"), docs))
    assert out.columns[: len(docs.columns)] == docs.columns and len(out.columns) == len(docs.columns) + len(MADE)
    assert out.count() > 5 and out.select(*[f"`{c}`" for c in docs.columns]).exceptAll(docs).count() == 0


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_run_with_an_empty_table(spark, tmp_path, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    none = {n: spark.read.parquet(f"{SF}/{n}.parquet").filter("false") for n in ("documents", "labels", "benchmark")}
    folder = write(spark, str(tmp_path / "in"), none["documents"] if empty == "documents" else docs, none["labels"] if empty == "labels" else None, none["benchmark"] if empty == "benchmark" else None)
    out = corpus_pipeline.run(spark, folder)
    assert (out.count() == 0) == (empty == "documents") and set(MADE) <= set(out.columns)
