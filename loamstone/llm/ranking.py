"""One ranking from several differently-scaled scores.

Scores are replaced by their ranks within a query, which puts every arm on the same footing whatever
its range. The first principal component of the rank-transformed scores comes from their correlation
matrix (one distributed aggregate of sums and products); its loadings are oriented to the declared
directions, and items are ordered by their projection. Where a query declares its own weights, the
projection runs along these, turned as the component's orientation says.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamstone.session import materialise

#: Groups of more rows than this are ranked in ranges, each in its own task.
GROUP_ROWS = 200_000


def rank_transform(rows: DataFrame, group: list[str], value: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``rows`` with ``footing`` in (0, 1): the mean rank of ``value`` in its group less a half, over
    the group's size. Ties share their mean rank.

    A group beyond ``group_rows`` is cut into ranges of about half that by approximate quantiles; a
    row's rank is the rows in earlier ranges plus its rank in its own, so no task gets the whole group
    and the result is the exact rank whatever the quantiles.
    """
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    hot = sizes.filter(F.col("_size") > group_rows)
    if hot.isEmpty():
        w = W.partitionBy(*group)
        o = w.orderBy(value)
        mean = F.rank().over(o) + (F.count(F.lit(1)).over(W.partitionBy(*group, value)) - 1) / 2
        return rows.withColumn("footing", (mean - 0.5) / F.count(F.lit(1)).over(w))
    hot = materialise(hot)
    steps = [i / 256 for i in range(1, 256)]
    cuts = rows.join(hot.drop("_size"), group, "left_semi").groupBy(*group).agg(F.array_distinct(F.percentile_approx(value, F.array(*map(F.lit, steps)), F.lit(10_000))).alias("_cuts"))
    placed = rows.join(materialise(cuts), group, "left").withColumn("_range", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(value))), F.lit(0))).drop("_cuts")
    placed = placed.withColumn("_range", F.greatest("_range", F.lit(0)))
    # A value held by many rows fills a range of its own: ranks come from counts of distinct values.
    values = placed.groupBy(*group, "_range", value).agg(F.count(F.lit(1)).alias("_same"))
    per_range = values.groupBy(*group, "_range").agg(F.sum("_same").alias("_n"))
    w = W.partitionBy(*group)
    offsets = per_range.withColumn("_before", F.coalesce(F.sum("_n").over(w.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_size", F.sum("_n").over(w))
    inside = W.partitionBy(*group, "_range").orderBy(value)
    ranked = values.withColumn("_less", F.sum("_same").over(inside) - F.col("_same")).join(offsets.drop("_n"), [*group, "_range"])
    footing = (F.col("_before") + F.col("_less") + F.col("_same") / 2) / F.col("_size")
    ranked = ranked.select(*group, "_range", value, footing.alias("footing"))
    return placed.join(ranked, [*group, "_range", value]).drop("_range")


def wide_footing(hits: DataFrame, group: str, item: list[str], arm: str, score: str, arms: list[str], group_rows: int = GROUP_ROWS) -> DataFrame:
    """A row for each item of a group with a column ``f_<arm>``: the rank-transformed score of each arm.

    A score that is missing, null or not a number counts as the arm's worst in the group (an arm
    without any score there is a tie of all items). Of several scores the greatest counts. Rows without
    a group are dropped.
    """
    clean = F.when(~F.isnan(F.col(score)), F.col(score).cast("double"))
    wide = hits.filter(F.col(group).isNotNull()).groupBy(group, *item).agg(*[F.max(F.when(F.col(arm) == a, clean)).alias(a) for a in arms])
    worst = wide.groupBy(F.col(group).alias("_g")).agg(*[F.coalesce(F.min(a), F.lit(0.0)).alias(f"_w_{a}") for a in arms])
    filled = wide.join(worst, F.col(group) == F.col("_g")).select(group, *item, *[F.coalesce(a, f"_w_{a}").alias(a) for a in arms])
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(a).alias("value")) for a in arms])).alias("_x")
    long = filled.select(group, *item, pairs).select(group, *item, "_x.arm", "_x.value")
    ranked = rank_transform(long, [group, "arm"], "value", group_rows)
    return ranked.groupBy(group, *item).agg(*[F.max(F.when(F.col("arm") == a, F.col("footing"))).alias(f"f_{a}") for a in arms])


def first_component(wide: DataFrame, columns: list[str], directions: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Loadings of the first principal component and the correlation matrix of ``columns``.

    The matrix is one aggregate row. The component is turned to agree with most of the declared
    directions, by the sum of its loadings along them; a column without variance has loading 0, and
    with no variance at all the loadings are the directions.
    """
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = wide.agg(*[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((k, k))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    spread = np.sqrt(np.diag(cov).clip(min=0.0))
    spread[spread < 1e-12] = np.inf
    matrix = cov / np.outer(spread, spread)
    if not matrix.any():
        return np.asarray(directions, float) / np.sqrt(k), matrix
    loadings = np.linalg.eigh(matrix)[1][:, -1]
    turn = float(np.dot(loadings, directions))
    return (loadings if turn >= 0 else -loadings), matrix


def fused_ranking(
    hits: DataFrame, group: str, item: list[str], arm: str, score: str, arms: list[str], directions: list[int] | None = None, weights: DataFrame | None = None, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Every item of every group with ``fused`` (its projection), the larger the better.

    Without ``weights`` the projection runs along the first principal component. ``weights`` has a row
    for each group with a column ``w_<arm>`` for each arm; they then take the place of the loadings'
    sizes, while a loading's sign along its declared direction decides nothing: a declared weight means
    the direction is known. Groups without weights follow the component. Repeated rows count once.
    """
    directions = directions or [1] * len(arms)
    wide = materialise(wide_footing(hits, group, item, arm, score, arms, group_rows))
    loadings, _ = first_component(wide, [f"f_{a}" for a in arms], directions)
    component = [F.lit(float(x)) for x in loadings]
    if weights is None:
        chosen: list[Column] = component
    else:
        once = weights.filter(F.col(group).isNotNull()).groupBy(group).agg(*[F.max(f"w_{a}").alias(f"w_{a}") for a in arms])
        wide = wide.join(once, group, "left")
        declared = F.lit(True)
        for a in arms:
            declared = declared & F.col(f"w_{a}").isNotNull()
        chosen = [F.when(declared, F.col(f"w_{a}") * d).otherwise(c) for a, d, c in zip(arms, directions, component)]
    fused = sum((w * F.col(f"f_{a}") for w, a in zip(chosen, arms)), F.lit(0.0))
    return wide.withColumn("fused", F.round(fused, 12)).select(group, *item, *[f"f_{a}" for a in arms], "fused")


def best_item(ranking: DataFrame, group: str, item: list[str]) -> DataFrame:
    """The first item of each group; on ties the smallest item (in the order of its columns, null first)."""
    return ranking.groupBy(group).agg(F.max_by(F.struct(*item), F.struct("fused", *[-F.col(c) for c in item])).alias("top")).select(group, *[F.col(f"top.{c}").alias(c) for c in item])


def alpha_weights(params: DataFrame) -> DataFrame:
    """Weights of the arms lexical, dense and usage: ``dense_alpha`` (null is 1) for the first, half of
    the rest for each other."""
    alpha = F.coalesce(F.col("dense_alpha").cast("double"), F.lit(1.0))
    rest = (1.0 - alpha) / 2
    return params.select("query_id", alpha.alias("w_lexical"), rest.alias("w_dense"), rest.alias("w_usage"))
