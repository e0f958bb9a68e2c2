"""Mixing sources to target weights by hierarchical budgets.

A tree of domains, languages and sources has weights on its branches. A token budget flows
from the root to the leaves in proportion to the weights; what a branch can't take up is
shared out among its siblings, and only what a whole family can't take up goes to the
family's own siblings. Each leaf then takes whole epochs of its documents and a token
prefix of one more epoch, in an order that a seed decides.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_LEAVES = 100_000
LEVELS = ("domain", "lang", "source")
_CELL_DIGITS = 3


def share_out(budget: int, weights: Sequence[float], limits: Sequence[int]) -> list[int]:
    """Whole parts of ``budget`` in proportion to ``weights``, none above its limit; what the
    limits leave over goes to the others. All of it is given out if the limits allow, but
    nothing to a branch of weight 0."""
    limits = [m if w > 0 else 0 for w, m in zip(weights, limits, strict=True)]
    budget = min(budget, sum(limits))
    given = [0] * len(weights)
    open_ = {k for k, m in enumerate(limits) if m > 0}
    rest = budget
    while open_:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if rest * weights[k] / total >= limits[k]}
        if not full:
            exact = {k: rest * weights[k] / total for k in open_}
            given = [int(exact[k]) if k in exact else given[k] for k in range(len(given))]
            break
        for k in full:
            given[k] = limits[k]
        rest -= sum(limits[k] for k in full)
        open_ -= full
    # the few tokens that rounding left over, in order: one each, then as they fit
    over = budget - sum(given)
    for most in (1, over):
        for k in range(len(given)):
            extra = min(over, limits[k] - given[k], most)
            given[k] += extra
            over -= extra
    return given


def leaf_budgets(budget: int, capacity: Mapping[tuple, int], weights: Mapping[tuple, float]) -> dict[tuple, int]:
    """Tokens for each leaf. ``capacity``: tokens that each leaf (a path from the root) can
    give; ``weights``: of any path, 1 where none is named. What is below a path of weight 0
    gives nothing and does not count as capacity of the branches above it."""
    capacity = {k: 0 if any(weights.get(k[:n], 1.0) <= 0 for n in range(1, len(k) + 1)) else v for k, v in capacity.items()}

    def down(path: tuple, leaves: list[tuple], budget: int) -> None:
        if leaves == [path]:
            found[path] = budget
            return
        children: dict[tuple, list[tuple]] = {}
        for leaf in leaves:
            children.setdefault(leaf[: len(path) + 1], []).append(leaf)
        names = sorted(children)
        parts = share_out(budget, [weights.get(x, 1.0) for x in names], [sum(capacity[y] for y in children[x]) for x in names])
        for name, part in zip(names, parts, strict=True):
            down(name, children[name], part)

    found: dict[tuple, int] = {}
    if capacity:
        down((), sorted(capacity), min(budget, sum(capacity.values())))
    return found


def mix(
    df: DataFrame,
    levels: Mapping[str, Column],
    tokens: Column,
    weights: Mapping[tuple, float],
    *,
    budget: int | None = None,
    share: float | None = None,
    max_epochs: int = 1,
    seed: int = 0,
    id_col: str = "doc_id",
) -> DataFrame:
    """The rows of ``df`` that the mix takes, once for each epoch that takes them, with a
    column ``mix_epoch`` (from 0) in place of any column of that name.

    ``levels`` are the tree's levels from the root down (nulls are a branch named 'null');
    ``tokens`` is a row's size (null counts as 0); the budget is given in tokens or as a
    share of all tokens. A leaf gives at most ``max_epochs`` times its tokens, one of weight 0
    (its own or that of a branch above) nothing, nor one whose rows all have 0 tokens. In an epoch
    rows come in the order of md5(seed|epoch|id), then id and a hash of the row; a row is
    taken where the rows before it stay below the leaf's remaining budget, so a leaf
    exceeds it by less than one row. An empty table or budget gives no rows.

    Totals by leaf are collected: at most ``MAX_LEAVES`` rows, or an error. Prefixes need no
    sort of a leaf: tokens are summed by 4,096 cells of the order, and only the cell where
    the budget ends is sorted.
    """
    kept = [c for c in df.columns if c != "mix_epoch"]
    leaf = F.array(*(F.coalesce(x.cast("string"), F.lit("null")) for x in levels.values()))
    rows = df.select(
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"),
        F.col(id_col).cast("string").alias("id"),
        leaf.alias("leaf"),
        F.coalesce(tokens.cast("long"), F.lit(0)).alias("tokens"),
    )
    totals = rows.groupBy("leaf").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).limit(MAX_LEAVES + 1).collect()
    if len(totals) > MAX_LEAVES:
        raise ValueError(f"the tree has more than {MAX_LEAVES} leaves")
    size = {tuple(r["leaf"]): r["tokens"] for r in totals}
    wanted = budget if budget is not None else int((share or 0) * sum(size.values()))
    given = leaf_budgets(wanted, {k: v * max_epochs for k, v in size.items()}, weights)
    plan = [(list(k), given[k] // size[k], given[k] % size[k]) for k in sorted(given) if size[k] and given[k]]
    plan = df.sparkSession.createDataFrame(plan, "leaf array<string>, epochs long, rest long")

    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce("id", F.lit(""))).cast("binary"))
    rows = rows.join(F.broadcast(plan), "leaf").withColumn("order", order).withColumn("cell", F.substring("order", 1, _CELL_DIGITS))
    by_leaf = Window.partitionBy("leaf").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = rows.where("rest > 0").groupBy("leaf", "cell", "rest").agg(F.sum("tokens").alias("t")).withColumn("upto", F.sum("t").over(by_leaf))
    ends = cells.where("upto >= rest and upto - t < rest").groupBy("leaf").agg(
        F.min_by(F.struct(F.col("cell").alias("end"), (F.col("upto") - F.col("t")).alias("before")), "cell").alias("e")
    ).select("leaf", "e.*")
    rows = rows.join(F.broadcast(ends), "leaf", "left")

    whole = rows.select(
        "row",
        "epochs",
        (F.col("cell") < F.col("end")).alias("more"),
    ).select("row", F.when(F.coalesce("more", F.lit(False)), F.col("epochs")).otherwise(F.col("epochs") - 1).alias("last")).where("last >= 0")
    whole = whole.select("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("mix_epoch"))
    inside = Window.partitionBy("leaf").orderBy("order", "id", "code").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where("cell = end").withColumn("code", F.xxhash64("row")).withColumn(
        "passed",
        F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)),
    )
    edge = edge.where("passed < rest").select("row", F.col("epochs").alias("mix_epoch"))
    return whole.unionByName(edge).select("row.*", "mix_epoch")
