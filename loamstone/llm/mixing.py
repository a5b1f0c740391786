"""Mixing sources to target weights by balanced (cube) sampling.

A source whose target is r times its size gives every document floor(r) copies and one more with
probability r - floor(r); with r beyond the allowed repeats the target is out of reach and every
document is repeated as often as allowed. The extra copies are drawn by the cube method: inclusion
probabilities move through the null space of two balancing equations (documents and tokens) until all
but two are 0 or 1. That flight runs in buckets of bounded size; the undecided of all buckets meet in
buckets again, level by level, until one small landing problem is left for each source.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.llm.tokens import token_count
from loamstone.session import materialise, one_row_per_key

#: Documents in a bucket of the flight phase.
BUCKET = 2048
_EPS = 1e-9


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Inclusion probabilities after the flight: at most two are still between 0 and 1, and the sums of
    p and of p * size (the expected documents and tokens) are what they were.

    Three undecided units are held at a time; a vector of the null space of their two equations is
    followed to the first border, and the decided unit makes way for the next.
    """
    p = p.astype(float).copy()
    pool = [i for i in range(len(p)) if _EPS < p[i] < 1 - _EPS]
    active, at = pool[:3], 3
    scale = max(float(size.max(initial=1.0)), 1.0)
    while len(active) == 3:
        i, j, k = active
        a, b, c = size[i] / scale, size[j] / scale, size[k] / scale
        u = (b - c, c - a, a - b)  # orthogonal to (1, 1, 1) and to the sizes
        if abs(u[0]) + abs(u[1]) + abs(u[2]) < 1e-12:
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for x, d in zip(active, u):
            if d > 0:
                up, down = min(up, (1 - p[x]) / d), min(down, p[x] / d)
            elif d < 0:
                up, down = min(up, p[x] / -d), min(down, (1 - p[x]) / -d)
        step = up if rng.random() * (up + down) < down else -down
        for x, d in zip(active, u):
            p[x] += step * d
        active = [x for x in active if _EPS < p[x] < 1 - _EPS]
        while len(active) < 3 and at < len(pool):
            active.append(pool[at])
            at += 1
    p[p < _EPS] = 0.0
    p[p > 1 - _EPS] = 1.0
    return p


def landing(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decides the last few units two at a time: one of a pair becomes 0 or 1 and the other takes over the
    rest, at odds that keep every inclusion probability and the sum; a last one is drawn by what it has left."""
    p = p.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1)).tolist()
    while len(open_) > 1:
        a, b = open_[:2]
        both = p[a] + p[b]
        if both < 1:
            won = rng.random() * both < p[a]
            p[a], p[b] = (both, 0.0) if won else (0.0, both)
        else:
            full = rng.random() * (2 - both) < 1 - p[b]
            p[a], p[b] = (1.0, both - 1) if full else (both - 1, 1.0)
        open_ = [x for x in (a, b) if _EPS < p[x] < 1 - _EPS] + open_[2:]
    for x in open_:
        p[x] = float(rng.random() < p[x])
    return np.where(p > 0.5, 1.0, 0.0)


def _seed(key: tuple, seed: int) -> np.random.Generator:
    return np.random.default_rng([seed, *[abs(int.from_bytes(str(k).encode(), "little")) % (1 << 61) for k in key]])


def _flyer(cols: list[str], key: str, probability: str, size: str, seed: int, level: int, last: bool):
    def fly(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable", ignore_index=True)
        rng = _seed((*keys, level), seed)
        pdf = pdf.iloc[rng.permutation(len(pdf))].reset_index(drop=True)
        weights = pdf[size].to_numpy(dtype=float)
        p = flight(pdf[probability].to_numpy(), weights, rng)
        pdf[probability] = landing(p, rng) if last else p
        return pdf[pdf[probability] > 0][cols]

    return fly


def cube_sample(units: DataFrame, by: list[str], key: str, probability: str, size: str, seed: int = 7, bucket: int = BUCKET) -> DataFrame:
    """(by, key) of the units that are drawn: balanced on their number and on ``size`` within ``by``.

    ``probability`` lies between 0 and 1. Each level keeps at most two of a bucket's units, so levels are
    few (units / 1000 at each) and the last has one bucket for each group.
    """
    cols = [*by, key, probability, size]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in units.select(*cols).schema.fields)
    left = units.select(*cols)
    drawn = None
    level = 0
    while True:
        counts = materialise(left.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")))
        largest = counts.agg(F.max("_n")).first()[0] or 0
        last = largest <= bucket

        fly = _flyer(cols, key, probability, size, seed, level, last)
        spread = left.join(counts, by).withColumn("_b", F.pmod(F.xxhash64(F.lit(level), key), F.greatest(F.lit(1), F.ceil(F.col("_n") / bucket))))
        after = materialise(spread.groupBy(*by, "_b").applyInPandas(fly, schema))
        sure = after.filter(F.col(probability) == 1.0).select(*by, key)
        drawn = sure if drawn is None else drawn.unionByName(sure)
        if last:
            return drawn
        left = after.filter(F.col(probability) < 1.0)
        level += 1


def source_name(column: str):
    """Sources are compared trimmed and in lower case; an empty one is none."""
    name = F.lower(F.trim(F.col(column)))
    return F.when(name != "", name)


def plan_mix(docs: DataFrame, targets: DataFrame, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Sized documents (doc_id, source, tokens), and a row for each (mix_id, source) target with the
    tokens wanted, those there, and the repeats each document gets. Of several rows for one target the
    greatest share counts; a target without share, repeats or budget asks for nothing."""
    docs = one_row_per_key(docs.select("doc_id", "text", "source"), "doc_id")
    sized = materialise(docs.select("doc_id", source_name("source").alias("source"), F.coalesce(token_count(F.col("text")), F.lit(0)).alias("tokens")))
    per_source = materialise(sized.groupBy("source").agg(F.sum("tokens").alias("available"), F.count(F.lit(1)).alias("docs")))
    total = per_source.agg(F.coalesce(F.sum("available"), F.lit(0))).first()[0]
    asked = targets.filter("mix_id is not null").select("mix_id", source_name("source").alias("source"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("target_share", "max_repeats", "budget_ratio")])
    asked = asked.filter("source is not null").groupBy("mix_id", "source").agg(F.max(F.struct("target_share", "max_repeats", "budget_ratio")).alias("t")).select("mix_id", "source", "t.*")
    plan = asked.join(per_source, "source", "left")
    plan = plan.withColumn("available", F.coalesce("available", F.lit(0))).withColumn("docs", F.coalesce("docs", F.lit(0)))
    plan = plan.withColumn("wanted", F.col("target_share") * F.col("budget_ratio") * F.lit(total))
    ratio = F.when(F.col("available") > 0, F.least(F.col("wanted") / F.col("available"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return sized, plan.withColumn("repeats", ratio)


def mix_sources(docs: DataFrame, targets: DataFrame, seed: int = 7, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """The mix (mix_id, source, doc_id, tokens, copies) and its report.

    The report has a row for each target: ``wanted``, ``available`` and ``repeats``, the ``reached`` tokens
    and documents, ``actual_share`` of the mix and ``out_of_reach``: the mix has every document of the source as
    often as allowed and still fewer tokens than wanted. Documents without a source belong
    to no target but count in the total; a source without documents is reached with 0.
    """
    sized, plan = plan_mix(docs, targets)
    plan = materialise(plan)
    units = sized.filter("source is not null").join(plan.select("mix_id", "source", "repeats", "max_repeats"), "source").filter("repeats > 0")
    units = units.withColumn("base", F.floor("repeats").cast("int")).withColumn("p", F.col("repeats") - F.col("base"))
    units = materialise(units)
    extra = cube_sample(units.filter("p > 0"), ["mix_id", "source"], "doc_id", "p", "tokens", seed, bucket).withColumn("extra", F.lit(1))
    mix = units.join(extra, ["mix_id", "source", "doc_id"], "left").withColumn("copies", F.col("base") + F.coalesce("extra", F.lit(0))).filter("copies > 0")
    got = mix.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached"), F.sum("copies").alias("reached_docs"), F.count_if(F.col("copies") >= F.col("max_repeats")).alias("full"))
    mix = mix.select("mix_id", "source", "doc_id", "tokens", "copies")
    whole = got.groupBy("mix_id").agg(F.sum("reached").alias("mix_tokens"))
    report = plan.join(got, ["mix_id", "source"], "left").join(whole, "mix_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    share = F.when(F.col("mix_tokens") > 0, F.coalesce("reached", F.lit(0)) / F.col("mix_tokens")).otherwise(0.0)
    spent = F.when(F.col("max_repeats") > 0, F.coalesce("full", F.lit(0))).otherwise(F.col("docs")) >= F.col("docs")
    report = report.withColumn("out_of_reach", spent & (F.coalesce("reached", F.lit(0)) < F.col("wanted")))
    report = report.select("mix_id", "source", "target_share", "max_repeats", "budget_ratio", "wanted", "available", "docs", "repeats", "out_of_reach", zero("reached"), zero("reached_docs"), share.alias("actual_share"))
    return mix, report
