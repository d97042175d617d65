"""Every licence rule fires on a text of its own, and labels and scores are those of a plain Python version."""

import re
import time

import brute
from siltworks.llm import licenses


def sample(regex):
    """A string that the regex matches: first alternatives, one of each optional part."""

    def write(parsed):
        out = ""
        for op, arg in parsed:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "IN":
                kind, value = arg[0]
                out += chr(value if str(kind) == "LITERAL" else value[0])
            elif name == "BRANCH":
                out += write(arg[1][0])
            elif name == "SUBPATTERN":
                out += write(arg[-1])
            elif name == "MAX_REPEAT":
                out += write(arg[2]) * max(1, arg[0])
            else:
                assert name == "ASSERT_NOT", name
        return out

    return write(re._parser.parse(regex))


def brute_scan(text):
    """(labels, score) by plain regexes over the words, all pairs of detections compared."""
    words = brute.words(text)
    joined = " " + " ".join(words) + " "
    found = []
    for r in licenses.rules():
        for m in re.finditer(f" {r['regex']}(?= )", joined):
            start = joined[: m.start()].count(" ")
            found.append((r["priority"], start, start + m.group().count(" "), r["label"], r["score"]))
    kept = [d for d in found if not any(e[0] < d[0] and e[1] <= d[1] and e[2] >= d[2] for e in found)]
    base = [label for label in brute.licenses(text)[4].split(",") if label]
    return ",".join(sorted({*base, *(d[3] for d in kept)})), max([0.8 if base else 0.0, *(d[4] for d in kept)])


def scanned(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    return [(r.labels, r.score) for r in rows], rows


def test_every_rule_fires_on_its_own_text(spark):
    rules = licenses.rules()
    texts = [f"before {sample(r['regex'])} after" for r in rules]
    got, rows = scanned(spark, texts)
    assert got == [brute_scan(t) for t in texts]
    for r, row in zip(rules, rows, strict=True):
        assert any(d.priority <= r["priority"] for d in row.detections), r


def test_documents_against_the_plain_version(spark):
    texts = [r[0] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text RLIKE '(?i)licen|mit|gpl|apache'").orderBy("doc_id").select("text").collect()][:150]
    got, _ = scanned(spark, texts)
    assert got == [brute_scan(t) for t in texts]


def test_a_long_text_full_of_matches(spark):
    text = " ".join("mit license and gpl v3 or later" if i % 2 else "plain words here" for i in range(4000))
    began = time.time()
    got, _ = scanned(spark, [text])
    assert got[0][0] == "gpl-3+,mit" and time.time() - began < 20
