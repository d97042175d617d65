"""Personal data: span candidates scored by boosted trees.

Base spans (email, ip, card, phone) follow fixed rules and always stay. Besides, generators of high recall propose
overlapping candidates: written-out addresses, IPv6, numbers grouped like cards or phones, and secrets. Boosted trees
over format and context features score them, a threshold for each kind (calibrated on rows the trees haven't seen)
selects, and what overlaps a base span or a better candidate goes.

The tables have no marked personal data, so the trees are fitted on a synthetic corpus drawn by a fixed seed from
written formats in matching and misleading contexts. Everything that touches documents is a SQL expression: spans stay
in the row as arrays, nothing is shuffled, and trees are nested conditions.

The patterns differ from the rules' wording where that would take quadratic time or deep recursion: attempts inside a
run that has already failed are ruled out by a look-behind (\\G still allows one right after a match), and repeats are
possessive. The matches are the same. Offsets are code points, ends exclusive.

Edge cases: null text counts as empty; texts without any candidate have counts 0 and the hash of no bytes; repeated
rows are scanned alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm import boosting
from siltworks.llm.common import text_or_empty
from siltworks.llm.spans import let, meets, places, tree

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
#: The rules' patterns, and what a match must pass. Fixed values.
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Candidates: kind and pattern. Fixed values.
GENERATORS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(]dot[\])]|dot ) ?[A-Za-z0-9-]{2,63}){1,4}"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} at [A-Za-z0-9-]{1,63}(?: dot [A-Za-z0-9-]{2,63}){1,4}"),
    ("ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[ .-]?[0-9]{2,6}){2,4}(?![0-9])"),
    ("phone", r"(?<![0-9+])(?:\([0-9]{2,4}\)|0[0-9]{1,4}|[0-9]{3})[ ./-]{0,2}[0-9]{3,4}[ ./-]?[0-9]{2,5}(?![0-9])"),
    ("secret", r"AKIA[0-9A-Z]{16}"),
    ("secret", r"(?i:password|passwd|token|secret|api_?key)\"? ?[=:] ?\"?[0-9A-Za-z_+/.-]{6,80}\"?"),
    ("secret", r"(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])"),
)
#: What a match of each generator has in it, in the generators' order. Rules of the base kinds match nothing without a digit or @.
NEEDS = (r"[\[(]at[\])]", r" at [A-Za-z0-9-]+ dot ", r"(?:[0-9A-Fa-f]{1,4}:){3}", r"[0-9]", r"[0-9]", r"AKIA", r"(?i:password|passwd|token|secret|api_?key)", r"[0-9a-f]{32}")
#: A text without a match of this has no span of any kind.
GATE = "[0-9@]|" + "|".join(dict.fromkeys(n for n in NEEDS if n != "[0-9]"))
CONTEXT = r"(?i)mail|contact|tel|phone|call|fax|mobile|card|visa|account|ip|host|addr|token|secret|passw|key|login"
#: Characters before a candidate that count as its context, and in a piece of a text in which it is looked up.
BEFORE, PIECE = 24, 1024
FEATURES = ("len", "digits", "alpha", "upper", "hex", "sep", "dots", "luhn", "context", "prev", "next", "kind")
PRECISION, TREES, EXAMPLES = 0.97, 24, 4000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return len(digits) >= 12 and total % 10 == 0


def describe(kind: str, value: str, before: str, after: str) -> list[float]:
    """FEATURES of a candidate, as the SQL has them."""
    n = lambda p: float(len(re.findall(p, value)))
    return [
        float(len(value)), n("[0-9]"), n("[A-Za-z]"), n("[A-Z]"), n("[0-9a-f]"), n("[ ()/:-]"), n("[.]"), float(luhn(re.sub("[^0-9]", "", value))),
        float(bool(re.search(CONTEXT, before[-BEFORE:]))), float(bool(re.search("[A-Za-z0-9_]$", before))), float(bool(re.match("[A-Za-z0-9_]", after))), float(KINDS.index(kind)),
    ]


def _examples(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n synthetic candidates and whether they are personal data."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    letters = lambda k, a="abcdefghijklmnopqrstuvwxyz": "".join(a[i] for i in rng.integers(0, len(a), k))
    prose = lambda: f"{letters(int(rng.integers(2, 9)))} {letters(int(rng.integers(2, 9)))} "

    def card(good: bool) -> str:
        body = pick("4", "51", "37", "6011") + digits(15)
        body = body[:15]
        check = next(c for c in "0123456789" if luhn(body + c) == good)
        return pick("{0}{1}{2}{3}", "{0} {1} {2} {3}", "{0}-{1}-{2}-{3}", "{0}.{1}.{2}.{3}").format(body[:4], body[4:8], body[8:12], body[12:] + check)

    def positive() -> tuple[str, str, str]:
        kind = pick(*KINDS)
        hint = pick("", {"email": "mail ", "ip": "host ", "card": "card ", "phone": "phone ", "secret": "key "}[kind])
        if kind == "email":
            dot = pick(".", " dot ", "[dot]", " (dot) ")
            value = letters(int(rng.integers(3, 9))) + pick("[at]", " [at] ", " (at) ", " at ") + letters(int(rng.integers(3, 9))) + dot + pick("com", "org", "net")
        elif kind == "ip":
            value = ":".join(letters(int(rng.integers(1, 5)), "0123456789abcdef") for _ in range(int(rng.integers(6, 9))))
        elif kind == "card":
            value = card(True)
        elif kind == "phone":
            value, hint = pick(("(" + digits(3) + ") " + digits(3) + "-" + digits(4), hint), (digits(3) + "-" + digits(3) + "-" + digits(4), "call "), ("0" + digits(3) + " " + digits(4) + "-" + digits(3), "tel "))
        else:
            value = pick("AKIA" + letters(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 'token = "' + letters(40, "0123456789abcdef") + '"', "password=" + letters(18, "0123456789abcdef"), letters(40, "0123456789abcdef"))
        return kind, value, prose() + hint

    def negative() -> tuple[str, str, str]:
        kind = pick(*KINDS)
        hint = pick("", "page ", "order ", "of ", "version ")
        if kind in ("card", "phone") and rng.random() < 0.25:  # digits inside an identifier
            return kind, digits(int(rng.integers(10, 17))), prose() + letters(int(rng.integers(4, 20)), "0123456789abcdef") + letters(1)
        if kind == "email":
            value = letters(5) + " at " + letters(6) + " dot " + letters(int(rng.integers(4, 11)))
        elif kind == "ip":
            value = ":".join(digits(2) for _ in range(4))
        elif kind == "card":
            value = pick(card(False), digits(4) + "-" + digits(2) + "-" + digits(2), digits(4) + " " + digits(4) + " " + digits(4))
        elif kind == "phone":
            value = pick(digits(3) + digits(4) + digits(2), digits(3) + "." + digits(3) + "." + digits(2), digits(3) + " " + digits(3) + " " + digits(3), digits(3) + digits(3) + digits(4))
        else:
            value = pick("token: " + letters(8), "secret: " + letters(7), "password: " + letters(6), letters(32, "0123456789"))
        return kind, value, prose() + hint

    rows = [(*(positive() if i % 2 else negative()), float(i % 2)) for i in range(n)]
    x = np.array([describe(kind, value, before, pick(" ", ".", " ", ",")) for kind, value, before, _ in rows])
    return x, np.array([r[3] for r in rows])


@functools.cache
def model(seed: int = 6) -> tuple[tuple, dict[str, float]]:
    """(trees, threshold of each kind): the lowest logit at which PRECISION holds on rows not used for the trees."""
    trees = boosting.fit(*_examples(seed, EXAMPLES), trees=TREES)
    x, y = _examples(seed + 1, EXAMPLES)
    got, thresholds = boosting.logit(trees, x), {}
    for k, kind in enumerate(KINDS):
        own = x[:, -1] == k
        order = np.argsort(-got[own], kind="stable")
        score, right = got[own][order], y[own][order]
        holds = np.flatnonzero(np.cumsum(right) / np.arange(1, len(right) + 1) >= PRECISION)
        thresholds[kind] = round(max(float(score[holds[-1]]), 0.0), 6) if len(holds) else float("inf")
    return tuple(trees), thresholds


def _places(pattern: str) -> str:
    """SQL for the places and texts of a pattern's matches in the column t."""
    return places("t", f"r'{pattern}'")


def _luhn(value: str) -> str:
    digits = f"regexp_replace({value}, '[^0-9]', '')"
    double = f"CAST(substring({digits}, length({digits}) - i, 1) AS INT) * (1 + i % 2)"
    return f"(length({digits}) >= 12 AND aggregate(transform(sequence(0, length({digits}) - 1), i -> {double} - 9 * int({double} > 9)), 0, (a, b) -> a + b) % 10 = 0)"


PASS = {
    "email": "true",
    "ip": rf"x.v RLIKE r'^{OCTET}(?:\.{OCTET}){{3}}$'",
    "card": _luhn("x.v"),
    "phone": "regexp_count(x.v, '[0-9]') BETWEEN 9 AND 15",
}


def _candidates() -> str:
    """SQL for all candidates with their features and logits; pieces_: the text in pieces of PIECE, as substring() takes time by the place in a text."""
    trees, _ = model()
    each = []
    for kind, pattern in GENERATORS:
        count = lambda p: f"regexp_count(x.v, r'{p}')"
        first = f"greatest(x.s - {BEFORE}, 0)"
        before = f"substring(concat(get(pieces_, {first} div {PIECE}), coalesce(get(pieces_, {first} div {PIECE} + 1), '')), int({first} % {PIECE}) + 1, least({BEFORE}, x.s))"
        after = f"coalesce(substring(get(pieces_, x.e div {PIECE}), int(x.e % {PIECE}) + 1, 1), '')"
        values = [
            "length(x.v)", count("[0-9]"), count("[A-Za-z]"), count("[A-Z]"), count("[0-9a-f]"), count("[ ()/:-]"), count("[.]"), f"int({_luhn('x.v')})",
            f"int({before} RLIKE r'{CONTEXT}')", f"int({before} RLIKE '[A-Za-z0-9_]$')", f"int({after} RLIKE '[A-Za-z0-9_]')", str(KINDS.index(kind)),
        ]
        named = ", ".join(f"double({v}) AS {f}" for v, f in zip(values, FEATURES, strict=True))
        each.append(f"transform({_places(pattern)}, x -> struct('{kind}' AS kind, x.s AS s, x.e AS e, struct({named}) AS f))")
    score = boosting.sql(list(trees), [f"c.f.{f}" for f in FEATURES])
    return f"transform(concat({', '.join(each)}), c -> struct(c.kind AS kind, c.s AS s, c.e AS e, {score} AS score))"


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: base counts and hash, all spans as a string and as an array (kind, s, e)."""
    _, thresholds = model()
    body = text_or_empty(text)
    out = docs.select(F.col(key).alias("doc_id"), F.when(body.rlike(GATE), body).otherwise("").alias("t"))
    out = out.select("doc_id", "t", *[F.expr(f"filter({_places(PATTERNS[k])}, x -> {PASS[k]})").alias(k) for k in BASE])
    keeps = " ".join(f"WHEN '{k}' THEN {f'{v:.6f}D' if np.isfinite(v) else '1e300D'}" for k, v in thresholds.items())
    # What overlaps a base span goes, then what overlaps a better candidate; ties go to the first, then the longest.
    pieces = f"regexp_extract_all(t, r'(?s).{{1,{PIECE}}}', 0)"
    free = let("based_", tree(f"concat({', '.join(BASE)})"), f"filter({_candidates()}, c -> c.score >= CASE c.kind {keeps} END AND NOT {meets('based_', 'c', 'true')})")
    better = "(x.score > c.score OR (x.score = c.score AND (x.s < c.s OR (x.s = c.s AND (x.e > c.e OR (x.e = c.e AND x.kind < c.kind))))))"
    best = let("good_", let("pieces_", pieces, free), let("rivals_", tree("good_"), f"filter(good_, c -> NOT {meets('rivals_', 'c', better)})"))
    out = out.withColumn("extra", F.expr(f"if(t = '', CAST(array() AS array<struct<kind:string,s:int,e:int,score:double>>), {best})"))
    mark = lambda k, spans: f"transform({spans}, x -> struct('{k}' AS kind, x.s AS s, x.e AS e))"
    base = "concat(" + ", ".join(mark(k, k) for k in BASE) + ")"

    def all_of(k: str) -> str:
        own = f"concat({mark(k, k)}, {mark(k, f"filter(extra, c -> c.kind = '{k}')")})" if k in BASE else mark(k, f"filter(extra, c -> c.kind = '{k}')")
        return let("sorted_", f"array_sort({own})", "filter(sorted_, (x, i) -> i = 0 OR x <> get(sorted_, i - 1))")

    every = "concat(" + ", ".join(map(all_of, KINDS)) + ")"
    text_of = lambda spans: f"array_join(transform({spans}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"
    out = out.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.expr(base).alias("base"), F.expr(every).alias("found"))
    return out.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(F.expr(text_of("base")), 256).alias("base_sha256"), F.expr(text_of("found")).alias("spans"), "found")


def redact(docs: DataFrame, mask: str = "[{kind}]") -> DataFrame:
    """docs (doc_id, text) with the found spans replaced; overlapping spans are masked as one, named after the first."""
    found = find(docs.select(F.struct("doc_id", "text").alias("both"), "text"), key="both").select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.text").alias("text"), "found")
    ordered = F.array_sort(F.transform("found", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    head, tail = mask.split("{kind}")
    made = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.when(x["s"] >= acc["at"], F.struct(x["e"].alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"]), F.lit(head), x["kind"], F.lit(tail)).alias("out"))).otherwise(
            F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    return found.select("doc_id", F.when(F.size("found") > 0, made).otherwise(F.col("text")).alias("text"))
