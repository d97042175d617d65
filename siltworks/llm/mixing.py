"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed in cells of source, language and topic. Cell weights are raked, one dimension after the
other, until the weighted tokens have the target share of every source, language and topic. The weights become
sampling probabilities c * weight, and each document is drawn by a hash of itself, so that a rerun or a lost executor
draws the same documents. c is the wanted fraction of all tokens, or where a probability would be over 1 the largest
found for which raking under the bound 1 / c still meets the targets: a cell can't give more than it has, and the
shares come before the size.

Only cells (not documents) are gathered, and only if a count shows MAX_CELLS of them at most; beyond that the same
raking, bounds and trials of c run as DataFrame sweeps with a checkpoint after each. Both give the same weights and c,
but for rounding. Sampling is the feature: selected is a column, rows stay.

Target shares may be given for some values of a dimension; the others share what is left in proportion to their observed
shares to a power.

Edge cases: null source, language or topic is the value '' of its dimension; empty texts have no tokens, take part in
no marginal and get the weight of their cell if it has one, else 1; target values without tokens are left out and the
rest is scaled up; where all values of a dimension have targets these are scaled to 1; an empty table gives an empty
result; repeated rows are drawn alike; input columns with the names of the columns made are replaced, unless the caller
gives these other names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import checkpointed, free_name, literal_rows, text_or_empty

#: Weights of cells, in a dict or in the column `weight` of a DataFrame.
Weights = dict | DataFrame
DIMENSIONS = ("source", "lang", "topic")
#: Columns made, unless the caller renames them; input columns of the final names are replaced.
MADE = ("topic", "tokens", "weight", "probability", "selected")
#: Up to so many cells the raking runs on the driver; a cell takes under 300 bytes there.
MAX_CELLS = 100_000
SWEEPS, TOLERANCE = 200, 1e-10
#: Relative error of token shares under bounded weights; a trial whose error hasn't halved in so many sweeps is given up.
CLOSE, STALL = 1e-6, 25
#: The share of all tokens that is drawn is searched in so many rounds, each of which divides the range by TRIALS.
ROUNDS, TRIALS = 4, 16
#: First match wins; what matches none is "prose". Fixed values.
TOPICS = (("table", r" \| "), ("license", "(?i)licen[sc]e"), ("contact", "@|password|token"), ("numbers", "[0-9]{4}"))


def topic_of(text: Column) -> Column:
    topic = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        topic = F.when(text.rlike(pattern), name).otherwise(topic)
    return topic


def tempered(marginal: dict[str, float], power: float) -> dict[str, float]:
    """Target shares: the observed ones to a power, which lifts small sources and languages."""
    raised = {k: v**power for k, v in marginal.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def shares(marginal: dict[str, float], given: dict[str, float], power: float) -> dict[str, float]:
    """The given shares of the values of a marginal; the other values share the rest by tempered()."""
    given = {k: v for k, v in given.items() if marginal.get(k, 0) > 0 and v >= 0}
    rest = tempered({k: v for k, v in marginal.items() if k not in given}, power)
    left = max(0.0, 1 - sum(given.values())) if rest else 0.0
    total = sum(given.values()) + left
    if total <= 0:
        return tempered(marginal, power)
    return {k: v / total for k, v in given.items()} | {k: v * left / total for k, v in rest.items()}


def rake(cells: dict[tuple, float], targets: list[dict[str, float]]) -> dict[tuple, float]:
    """Weights of cells whose weighted sums have the target shares; cells of values without a target get 0."""
    total = sum(cells.values())
    weights = {c: 1.0 if n > 0 else 0.0 for c, n in cells.items()}
    for _ in range(SWEEPS):
        worst = 0.0
        for d, target in enumerate(targets):
            sums: dict[str, float] = {}
            for c in sorted(cells):
                sums[c[d]] = sums.get(c[d], 0.0) + cells[c] * weights[c]
            factor = {v: target.get(v, 0.0) * total / s if s > 0 else 0.0 for v, s in sums.items()}
            worst = max([worst, *(abs(f - 1) for v, f in factor.items() if sums[v] > 0)])
            weights = {c: w * factor[c[d]] for c, w in weights.items()}
        if worst < TOLERANCE:
            break
    return weights


def rake_frames(cells: DataFrame, targets: list[DataFrame]) -> DataFrame:
    """rake() where the cells are too many for the driver; targets: DataFrames (value, share)."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    out = cells.withColumn("weight", F.when(F.col("tokens") > 0, 1.0).otherwise(0.0))
    for _ in range(SWEEPS):
        worst = 0.0
        for name, target in zip(DIMENSIONS, targets, strict=True):
            sums = out.groupBy(name).agg(F.sum(F.col("tokens") * F.col("weight")).alias("mass"))
            factors = checkpointed(
                sums.join(target.withColumnRenamed("value", name), name, "left").select(name, F.when(F.col("mass") > 0, F.coalesce("share", F.lit(0.0)) * total / F.col("mass")).otherwise(0.0).alias("factor"), "mass")
            )
            worst = max(worst, factors.filter("mass > 0").agg(F.max(F.abs(F.col("factor") - 1))).first()[0] or 0.0)
            out = out.join(factors.select(name, "factor"), name).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")
        out = checkpointed(out)
        if worst < TOLERANCE:
            break
    return out


def _decided(worst: list[np.ndarray]) -> tuple[np.ndarray, bool]:
    """(which trials have met the targets, whether the others won't), from each sweep's largest relative errors."""
    met = np.minimum.reduce(worst) <= CLOSE
    stalled = len(worst) > 2 * STALL and worst[-1] > 0.5 * worst[-1 - STALL]
    return met, bool((met | stalled).all())


def rake_bounded(cells: dict[tuple, float], targets: list[dict[str, float]], most: list[float]) -> list[dict[tuple, float] | None]:
    """For each of `most`: rake() with no weight over it; None if the targets aren't met so."""
    keys = sorted(c for c in cells if cells[c] > 0)
    n, total, bounds = np.array([cells[c] for c in keys]), sum(cells.values()), np.array(most)[:, None]
    sides = []
    for d, target in enumerate(targets):
        values, at = np.unique([c[d] for c in keys], return_inverse=True)
        sides.append((at, np.array([target.get(v, 0.0) * total for v in values.tolist()])))
    free, worst = np.ones((len(most), len(keys))), []
    for _ in range(SWEEPS):
        off = np.zeros(len(most))
        for at, want in sides:
            sums = np.array([np.bincount(at, x, len(want)) for x in n * np.minimum(free, bounds)])
            factor = np.divide(want, sums, out=np.zeros_like(sums), where=sums > 0)
            off = np.maximum(off, np.where(sums > 0, np.abs(factor - 1), 0.0).max(axis=1, initial=0.0))
            free = np.minimum(free * factor[:, at], 1e100)
        worst.append(off)
        met, over = _decided(worst)
        if over:
            break
    weights = np.minimum(free, bounds)
    return [dict.fromkeys(cells, 0.0) | dict(zip(keys, w.tolist(), strict=True)) if m else None for m, w in zip(met, weights, strict=True)]


def rake_bounded_frames(cells: DataFrame, targets: list[DataFrame], most: list[float]) -> list[DataFrame | None]:
    """rake_bounded() where the cells are too many for the driver; targets: DataFrames (value, share). All trials take the same sweeps."""
    total, some = cells.agg(F.sum("tokens")).first()[0] or 0, range(len(most))
    out, worst = cells.withColumn("free", F.array(*[F.when(F.col("tokens") > 0, 1.0).otherwise(0.0) for _ in most])), []
    for _ in range(SWEEPS):
        off = np.zeros(len(most))
        for name, target in zip(DIMENSIONS, targets, strict=True):
            sums = out.groupBy(name).agg(*[F.sum(F.col("tokens") * F.least(F.col("free")[i], F.lit(most[i]))).alias(f"mass{i}") for i in some])
            share = F.coalesce("share", F.lit(0.0)) * total
            factor = F.array(*[F.when(F.col(f"mass{i}") > 0, share / F.col(f"mass{i}")).otherwise(0.0) for i in some])
            far = F.array(*[F.when(F.col(f"mass{i}") > 0, F.abs(share / F.col(f"mass{i}") - 1)).otherwise(0.0) for i in some])
            factors = checkpointed(sums.join(target.withColumnRenamed("value", name), name, "left").select(name, factor.alias("factor"), far.alias("far")))
            off = np.maximum(off, [x or 0.0 for x in factors.agg(*[F.max(F.col("far")[i]) for i in some]).first()])
            out = out.join(factors.select(name, "factor"), name).withColumn("free", F.zip_with("free", "factor", lambda x, y: F.least(x * y, F.lit(1e100)))).drop("factor")
        out = checkpointed(out)
        worst.append(off)
        met, over = _decided(worst)
        if over:
            break
    return [out.withColumn("weight", F.least(F.col("free")[i], F.lit(most[i]))).drop("free") if met[i] else None for i in some]


def largest(low: float, high: float, weights: Weights, bounded: Callable[[list[float]], list[Weights | None]]) -> tuple[float, Weights]:
    """(c, weights): the largest c found in low to high for which bounded() gives weights under 1 / c; low's own are given."""
    for k in range(ROUNDS):
        tried = [low + (high - low) * i / TRIALS for i in range(1, TRIALS)] + [high] * (k == 0)
        found = bounded([1 / c for c in tried])
        best = max((i for i, w in enumerate(found) if w is not None), default=-1)
        if best >= 0:
            low, weights = tried[best], found[best]
        if low == high:
            break
        if best + 1 < len(tried):
            high = tried[best + 1]
    return low, weights


def fit(cells: dict[tuple, float], targets: list[dict[str, float]], fraction: float) -> tuple[float, dict[tuple, float]]:
    """(share of all tokens, weights): the largest share up to fraction found whose weighted cells fit in the cells."""
    weights = rake(cells, targets)
    low = min(fraction, 1 / max([1e-300, *weights.values()]))
    if low == fraction:
        return low, weights
    total, high = sum(cells.values()), fraction
    for d, target in enumerate(targets):
        sums: dict[str, float] = {}
        for c in sorted(cells):
            sums[c[d]] = sums.get(c[d], 0.0) + cells[c]
        high = min([high, *(sums[v] / (share * total) for v, share in target.items() if share > 0 and sums.get(v, 0) > 0)])
    return largest(low, max(low, high), weights, lambda most: rake_bounded(cells, targets, most))


def fit_frames(cells: DataFrame, targets: list[DataFrame], fraction: float) -> tuple[float, DataFrame]:
    """fit() where the cells are too many for the driver: the same sweeps, bounds and trials, so the same result but for rounding."""
    weights = rake_frames(cells, targets)
    low = min(fraction, 1 / (weights.agg(F.max("weight")).first()[0] or 1e-300))
    if low == fraction:
        return low, weights
    total, high = cells.agg(F.sum("tokens")).first()[0] or 0, fraction
    for name, target in zip(DIMENSIONS, targets, strict=True):
        sums = cells.groupBy(F.col(name).alias("value")).agg(F.sum("tokens").alias("n")).filter("n > 0").join(target.filter("share > 0"), "value")
        high = min(high, sums.agg(F.min(F.col("n") / (F.col("share") * total))).first()[0] or high)
    return largest(low, max(low, high), weights, lambda most: rake_bounded_frames(cells, targets, most))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = 0.7, fraction: float = 0.8, max_cells: int = MAX_CELLS, names: dict[str, str] | None = None) -> DataFrame:
    """docs with topic, tokens, weight, probability and selected, under these names or those of `names`.

    targets: shares by dimension and value; values without any share the rest by their observed shares to `power`.
    fraction: of all tokens, the expected share of the sample; less where the targets can't be met by so many.
    """
    spark, body = docs.sparkSession, text_or_empty()
    topic, tokens, weight, probability, selected = ((names or {}).get(n, n) for n in MADE)
    part = docs.drop(topic, tokens, weight, probability, selected)
    u, source, lang = (free_name(part, n) for n in ("_u", "_source", "_lang"))
    part = part.withColumns(
        {
            topic: topic_of(body),
            tokens: F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"),
            u: (F.shiftrightunsigned(F.xxhash64("doc_id", body), 11)).cast("double") / float(1 << 53),
            source: F.coalesce("source", F.lit("")),
            lang: F.coalesce("lang", F.lit("")),
        }
    )
    cells = checkpointed(part.groupBy(F.col(source).alias("source"), F.col(lang).alias("lang"), F.col(topic).alias("topic")).agg(F.sum(tokens).alias("tokens")))
    targets = targets or {}
    if cells.count() <= max_cells:
        held = {(r[0], r[1], r[2]): float(r[3]) for r in cells.collect()}
        goal = []
        for d, name in enumerate(DIMENSIONS):
            sums: dict[str, float] = {}
            for c in sorted(held):
                sums[c[d]] = sums.get(c[d], 0.0) + held[c]
            goal.append(shares(sums, targets.get(name, {}), power))
        c, weights = fit(held, goal, fraction)
        rows = [dict(zip(DIMENSIONS, k, strict=True)) | {"weight": weights[k], "probability": (min(1.0, c * weights[k]) if weights[k] > 0 else 0.0) if held[k] else 1.0} for k in sorted(held)]
        fitted = F.broadcast(literal_rows(spark, rows, "source string, lang string, topic string, weight double, probability double"))
    else:
        goals = [checkpointed(_goal(cells, name, targets.get(name, {}), power)) for name in DIMENSIONS]
        c, raked = fit_frames(cells, goals, fraction)
        fitted = raked.select(*DIMENSIONS, "weight", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), c * F.col("weight"))).otherwise(1.0).alias("probability"))
    p, f = part.alias("p"), fitted.alias("f")
    joined = p.join(f, (F.col(f"p.{source}") == F.col("f.source")) & (F.col(f"p.{lang}") == F.col("f.lang")) & (F.col(f"p.{topic}") == F.col("f.topic")))
    return joined.select(
        *[F.col(f"p.`{x}`") for x in part.columns if x not in (u, source, lang)],
        F.col("f.weight").alias(weight),
        F.col("f.probability").alias(probability),
        (F.col(f"p.{u}") < F.col("f.probability")).alias(selected),
    )


def _goal(cells: DataFrame, name: str, given: dict[str, float], power: float) -> DataFrame:
    """shares() of one dimension as a DataFrame (value, share)."""
    sums = cells.groupBy(name).agg(F.sum("tokens").alias("n")).filter("n > 0").withColumnRenamed(name, "value")
    stated = literal_rows(cells.sparkSession, [{"value": k, "want": v} for k, v in sorted(given.items()) if v >= 0], "value string, want double")
    sums = checkpointed(sums.join(stated, "value", "left").withColumn("raised", F.when(F.col("want").isNull(), F.pow(F.col("n").cast("double"), F.lit(power)))))
    want, raised, every = sums.agg(F.coalesce(F.sum("want"), F.lit(0.0)), F.coalesce(F.sum("raised"), F.lit(0.0)), F.sum(F.pow(F.col("n").cast("double"), F.lit(power)))).first()
    left = max(0.0, 1 - want) if raised > 0 else 0.0
    if want + left <= 0:
        return sums.select("value", (F.pow(F.col("n").cast("double"), F.lit(power)) / F.lit(every or 1.0)).alias("share"))
    return sums.select("value", F.coalesce(F.col("want"), F.col("raised") * (left / (raised or 1.0))).alias("part")).select("value", (F.col("part") / F.lit(want + left)).alias("share"))
