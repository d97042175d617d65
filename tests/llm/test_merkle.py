"""The manifest against trees built one node at a time."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from siltworks.llm import merkle

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, g string, digest string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"])))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, at):
    """(is on the left, sibling) of each level; None where a node stands alone."""
    out = []
    for nodes in levels[:-1]:
        run = nodes[at // 2 * 2 : at // 2 * 2 + 2]
        out.append(None if len(run) == 1 else (at % 2 == 1, run[1 - at % 2]))
        at //= 2
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for g in names}
    trees = {g: tree([leaf(r) for r in made[g]]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(made[g]):
            steps = path(trees[g], i) + path(top, k)
            changed = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None:
                changed["n_chars"] += 1
            now = leaf(changed)
            for s in steps:
                now = digest(now if s is None else s[1] + now if s[0] else now + s[1])
            out.append((r["doc_id"], trees[g][0][i], trees[g][-1][0], top[-1][0], digest("".join(s[1] for s in steps if s)), now, now == top[-1][0]))
    return sorted(out, key=str)


def rows_of(n):
    langs = ["en"] * 7 + ["de", None, "é", ""]
    return [dict(doc_id=i * 3, source=None if i % 5 == 0 else f"s{i % 2}", lang=langs[i % len(langs)], n_chars=None if i % 4 == 1 else i, text=[None, "", "ü" * i, "a\nb"][i % 4], g="clash", digest="clash") for i in range(n)]


def found(spark, rows, step):
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], COLUMNS).repartition(5)
    made = merkle.verified(merkle.manifest(docs, extra={"changed": merkle.tampered(docs)}, step=step), "changed")
    return sorted(map(tuple, made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize(("n", "step"), [(61, 2), (61, 8), (1, 8), (40, 1)])
def test_manifest_against_a_plain_tree(spark, n, step):
    rows = rows_of(n)
    got = found(spark, rows, step)
    assert got == brute(rows)
    assert n == 1 or {v for *_, v in got} == {True, False}


def test_repeated_rows_null_keys_and_no_rows(spark):
    rows = rows_of(9)
    rows += [dict(rows[3]), dict(rows[3]), dict(rows[4], text="other"), dict(rows[5], doc_id=None), dict(rows[5], doc_id=None)]
    assert found(spark, rows, 2) == brute(rows)
    assert found(spark, [], 2) == []


def test_a_proof_needs_its_own_leaf_and_order(spark):
    rows = rows_of(20)
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], COLUMNS)
    made = merkle.manifest(docs).cache()
    assert made.filter(merkle.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    swapped = F.transform("proof", lambda x: F.translate(x, "<>", "><"))
    assert made.filter((F.size(F.filter("proof", lambda x: x != "=")) > 0) & (merkle.folded(F.col("leaf"), swapped) == F.col("root"))).count() == 0
    assert made.filter(merkle.folded(F.sha2(F.col("leaf").cast("binary"), 256), F.col("proof")) == F.col("root")).count() == 0
