"""The drawn sample, not only the weights, has the target token shares."""

import pytest

from siltworks.llm import mixing


def test_expected_shares_meet_the_targets(spark):
    texts = [("a", "en", "w " * 900), ("b", "en", "w " * 80), ("b", "fr", "w x " * 30), ("a", "fr", "w " * 50), ("c", "en", "x | y " * 5), ("c", "fr", "x | y " * 9), ("a", "en", "x | y " * 10)]
    docs = spark.createDataFrame([(i, t, lang, s) for i, (s, lang, t) in enumerate(texts)], "doc_id long, text string, lang string, source string")
    rows = mixing.mix(docs, power=0.7, fraction=0.8).select("source", "lang", "topic", "tokens", "probability").collect()
    total, drawn = sum(r.tokens for r in rows), sum(r.tokens * r.probability for r in rows)
    assert 0.05 * total < drawn <= 0.8001 * total and max(r.probability for r in rows) <= 1 + 1e-9
    for name in mixing.DIMENSIONS:
        sums = {v: sum(r.tokens for r in rows if r[name] == v) for v in {r[name] for r in rows}}
        for value, share in mixing.tempered({v: n / total for v, n in sums.items()}, 0.7).items():
            assert sum(r.tokens * r.probability for r in rows if r[name] == value) / drawn == pytest.approx(share, rel=1e-4)


def test_the_bounded_sample_is_the_same_however_many_cells(spark, monkeypatch):
    """Where a probability would be over 1, the tables' way gives the c and the weights of the driver's."""
    for name, value in {"ROUNDS": 1, "TRIALS": 4, "SWEEPS": 6, "CLOSE": 0.05}.items():  # few sweeps, as each is a few jobs
        monkeypatch.setattr(mixing, name, value)
    texts = [("a", "en", "w " * 900), ("b", "en", "w " * 80), ("b", "fr", "w x " * 30), ("a", "fr", "w " * 50), ("c", "en", "x | y " * 5), ("c", "fr", "x | y " * 9), ("a", "en", "x | y " * 10), ("d", "en", " ")]
    docs = spark.createDataFrame([(i, t, lang, s) for i, (s, lang, t) in enumerate(texts)], "doc_id long, text string, lang string, source string")
    one, two = (mixing.mix(docs, power=0.7, fraction=0.8, max_cells=most).select("doc_id", "tokens", "weight", "probability").orderBy("doc_id").collect() for most in (mixing.MAX_CELLS, 0))
    assert [r.probability for r in two] == pytest.approx([r.probability for r in one], rel=1e-9)
    assert [r.weight for r in two] == pytest.approx([r.weight for r in one], rel=1e-9)
    drawn = sum(r.tokens * r.probability for r in two) / sum(r.tokens for r in two)
    assert drawn > 0.43  # 0.3933 if c falls until no probability is over 1
