"""The property graph as node and edge tables, and budgeted expansion over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import cut, sent

#: Relationship types and the directions in which they are followed, in order.
POLICY = (
    ("CITES", "out"),
    ("REFERENCES", "out"),
    ("REFERENCES", "in"),
    ("CONTINUES", "out"),
    ("CONTINUES", "in"),
    ("NEXT", "out"),
    ("NEXT", "in"),
    ("BELONGS_TO", "out"),
    ("BELONGS_TO", "in"),
)
MAX_DEPTH, MAX_NEIGHBORS, MAX_EVIDENCE, MAX_COST = 2, 10, 50, 500


def key(mark: str, column: str) -> Column:
    return F.concat(F.lit(mark), F.col(column).cast("string"))


def nodes(units: DataFrame) -> DataFrame:
    """Units (ku_id, document_id, section_id, modality) to nodes: id, document_id, labels.
    A document, each section that a unit has, and each unit with its modality's label."""
    docs = units.select(key("d", "document_id").alias("id"), "document_id").distinct().withColumn("labels", F.array(F.lit("Document")))
    sections = units.where("section_id is not null").select(
        key("s", "section_id").alias("id"),
        "document_id",
    ).distinct().withColumn("labels", F.array(F.lit("Section")))
    own = units.select(key("k", "ku_id").alias("id"), "document_id", F.array(F.lit("KnowledgeUnit"), F.initcap("modality")).alias("labels"))
    return docs.unionByName(sections).unionByName(own)


def _edges(rows: DataFrame, src: Column, dst: Column, kind: str) -> DataFrame:
    return rows.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"))


def containment(units: DataFrame) -> DataFrame:
    """BELONGS_TO edges: unit to document, unit to section, section to document once."""
    own, doc, section = key("k", "ku_id"), key("d", "document_id"), key("s", "section_id")
    in_section = units.where("section_id is not null")
    return _edges(units, own, doc, "BELONGS_TO").unionByName(
        _edges(in_section, own, section, "BELONGS_TO")
    ).unionByName(_edges(in_section.select("section_id", "document_id").distinct(), section, doc, "BELONGS_TO"))


def sequence(units: DataFrame) -> DataFrame:
    """NEXT edges from each unit to the one after it in its document."""
    after = F.lead("ku_id").over(Window.partitionBy("document_id").orderBy("ord"))
    return _edges(units.withColumn("after", after).where("after is not null"), key("k", "ku_id"), key("k", "after"), "NEXT")


def project(units: DataFrame, relationships: DataFrame) -> DataFrame:
    """All edges: containment, sequence and the relationships (source, target, type)."""
    named = relationships.select(key("k", "source").alias("src"), key("k", "target").alias("dst"), F.upper("type").alias("type"))
    return containment(units).unionByName(sequence(units)).unionByName(named)


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and outgoing edges of each document."""
    out = edges.join(nodes.select(F.col("id").alias("src"), "document_id"), "src").groupBy("document_id").agg(F.count(F.lit(1)).alias("edges"))
    count = nodes.groupBy("document_id").agg(F.count(F.lit(1)).alias("nodes"))
    return count.join(out, "document_id", "full").select(
        "document_id",
        F.coalesce("nodes", F.lit(0)).alias("nodes"),
        F.coalesce("edges", F.lit(0)).alias("edges"),
    )


def replace(table: DataFrame, fresh: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``table`` with the rows of the documents in ``fresh`` replaced by those, once for each
    key. The rows that stay are not shuffled while the documents are few enough to be sent."""
    kept = table.join(sent(fresh.select("document_id")), "document_id", "left_anti")
    return kept.unionByName(fresh.dropDuplicates([*keys]))


def directed(edges: DataFrame) -> DataFrame:
    """node, neighbor, type, direction, policy: each edge as its ends may follow it."""
    rules = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(d).alias("direction"), F.lit(k).alias("policy")) for k, (t, d) in enumerate(POLICY)))
    rows = edges.withColumn("r", F.explode(F.filter(rules, lambda x: x["t"] == F.col("type"))))
    out = F.col("r.direction") == "out"
    return rows.select(
        F.when(out, F.col("src")).otherwise(F.col("dst")).alias("node"),
        F.when(out, F.col("dst")).otherwise(F.col("src")).alias("neighbor"),
        "type",
        F.col("r.direction").alias("direction"),
        F.col("r.policy").alias("policy"),
    )


def neighbors(edges: DataFrame, nodes: DataFrame, wanted: DataFrame, types: list[str], direction: str) -> DataFrame:
    """One-hop neighbours of the wanted nodes (column id) over edges of the types in one
    direction: node, neighbor, type, labels."""
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    rows = edges.where(F.col("type").isin(types)).select(F.col(a).alias("node"), F.col(b).alias("neighbor"), "type")
    return rows.join(
        wanted.select(F.col("id").alias("node")).distinct(),
        "node",
    ).join(nodes.select(F.col("id").alias("neighbor"), "labels"), "neighbor")


def adjacency(edges: DataFrame, most: int = MAX_NEIGHBORS, nodes: DataFrame | None = None) -> DataFrame:
    """The first ``most`` neighbours of each node in policy order, then by id, with the
    node's full degree; of ``nodes`` (column node) alone, if given. The cap comes before any
    join, so a hub joins as ``most`` rows, and neither it nor the degree brings a hub's edges together."""
    rows = directed(edges)
    if nodes is not None:
        rows = cut(rows.join(nodes.select("node").distinct(), "node", "left_semi"))  # read once for both uses
    degree = rows.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("policy", "neighbor"))
    return rows.withColumn("place", place).where(F.col("place") <= most).join(degree, "node")


def expand(
    seeds: DataFrame,
    adjacent: DataFrame | Callable[[DataFrame], DataFrame],
    *,
    depth: int = MAX_DEPTH,
    most_evidence: int = MAX_EVIDENCE,
    most_cost: int = MAX_COST,
) -> tuple[DataFrame, DataFrame]:
    """Units reached from the seeds (query_id, id, rank) within all budgets.

    ``adjacent`` has the neighbours by node, or gives those of the nodes it is called with
    (``lambda nodes: adjacency(edges, nodes=nodes)``). Each level asks for its frontier alone, and what is
    written between jobs is the frontier's own edges, so it grows with the seeds, not with the graph.

    Returns (found, cost): found has query_id, id, place (order of discovery from 1), depth
    and hops, an array of (source, target, type, direction); cost has query_id, cost and
    exhausted (null, 'max_total_evidence' or 'max_traversal_cost').

    A node is expanded while the degrees of the nodes before it sum to less than the cost
    budget and fewer units than the evidence budget were found before it; a neighbour is
    taken where it is new and the evidence budget is not used up. Both are prefixes of the
    order (frontier place, neighbour place), so running sums replace the traversal's loop.
    """
    seeds = cut(seeds)
    near_of = adjacent if callable(adjacent) else lambda nodes: adjacent.join(nodes, "node", "left_semi")
    hop = "array<struct<source:string,target:string,type:string,direction:string>>"
    frontier = seeds.select("query_id", "id", F.col("rank").cast("long").alias("place"), F.array().cast(hop).alias("hops"))
    visited = seeds.select("query_id", "id")
    state = seeds.select("query_id").distinct().select("query_id", F.lit(0).cast("long").alias("cost0"), F.lit(0).cast("long").alias("found0"))
    found = None
    exhausted = None
    per_query = Window.partitionBy("query_id")
    for level in range(1, depth + 1):
        asked = near_of(frontier.select(F.col("id").alias("node")).distinct())
        near = cut(asked.select(F.col("node").alias("id"), "neighbor", "type", "direction", F.col("place").alias("n"), "degree"))
        degrees = near.select("id", "degree").distinct()
        before = per_query.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        cost = F.col("cost0") + F.coalesce(F.sum("degree").over(before), F.lit(0))
        own = frontier.join(degrees, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).join(state, "query_id").withColumn("cost", cost)
        own = cut(own)
        open_ = own.where((F.col("cost") < most_cost) & (F.col("found0") < most_evidence))
        rows = open_.join(near.drop("degree"), "id").join(visited.select("query_id", F.col("id").alias("neighbor")), ["query_id", "neighbor"], "left_anti")
        first = F.row_number().over(Window.partitionBy("query_id", "neighbor").orderBy("place", "n"))
        rows = rows.withColumn("_first", first).where("_first = 1")
        is_unit = F.col("neighbor").startswith("k").cast("long")
        upto = F.coalesce(F.sum(is_unit).over(per_query.orderBy("place", "n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = cut(rows.withColumn("upto", F.col("found0") + upto))
        taken = rows.where(F.col("upto") < most_evidence)
        order = F.row_number().over(per_query.orderBy("place", "n"))
        step = F.struct(F.col("id").alias("source"), F.col("neighbor").alias("target"), "type", "direction")
        taken = taken.select(
            "query_id",
            F.col("neighbor").alias("id"),
            order.cast("long").alias("place"),
            F.array_append("hops", step).alias("hops"),
            F.col("upto"),
        )
        # Only nodes that come before the evidence budget is used up add to the cost.
        new_units = rows.where(F.col("neighbor").startswith("k")).groupBy("query_id", F.col("id")).agg(F.count(F.lit(1)).alias("new_units"))
        reached = open_.join(new_units, ["query_id", "id"], "left")
        found_before = F.col("found0") + F.coalesce(F.sum(F.coalesce("new_units", F.lit(0))).over(before), F.lit(0))
        reached = reached.withColumn("found_before", found_before)
        spent = reached.where(F.col("found_before") < most_evidence).groupBy("query_id").agg(F.sum("degree").alias("spent"))
        units = taken.where(F.col("id").startswith("k")).withColumn("depth", F.lit(level))
        got = units.groupBy("query_id").agg(F.count(F.lit(1)).alias("got"))
        frontier_size = own.groupBy("query_id").agg(F.count(F.lit(1)).alias("size"), F.count_if((F.col("cost") >= most_cost)).alias("cut"))
        over = rows.groupBy("query_id").agg(F.max((F.col("upto") >= most_evidence)).alias("over"))
        late = reached.groupBy("query_id").agg(F.max(F.col("found_before") >= most_evidence).alias("late"))
        now = state.join(spent, "query_id", "left").join(got, "query_id", "left").join(frontier_size, "query_id", "left").join(over, "query_id", "left").join(late, "query_id", "left")
        some = F.coalesce("size", F.lit(0)) > 0
        why = F.when(
            some & ((F.col("found0") >= most_evidence) | F.coalesce("over", F.lit(False)) | F.coalesce("late", F.lit(False))),
            "max_total_evidence",
        ).when(some & (F.coalesce("cut", F.lit(0)) > 0), "max_traversal_cost")
        now = now.select(
            "query_id",
            (F.col("cost0") + F.coalesce("spent", F.lit(0))).alias("cost0"),
            (F.col("found0") + F.coalesce("got", F.lit(0))).alias("found0"),
            why.alias(f"why{level}"),
        )
        reasons = now.select("query_id", f"why{level}")
        exhausted = reasons if exhausted is None else exhausted.join(reasons, "query_id")
        state = now.select("query_id", "cost0", "found0")
        found = units if found is None else found.unionByName(units)
        visited = visited.unionByName(taken.select("query_id", "id"))
        frontier = taken.select("query_id", "id", "place", "hops")
    place = F.row_number().over(per_query.orderBy("depth", "place"))
    found = found.withColumn("place", place).select("query_id", "id", "place", "depth", "hops")
    costs = state.join(exhausted, "query_id").select(
        "query_id",
        F.col("cost0").alias("cost"),
        F.coalesce(*(f"why{k}" for k in range(depth, 0, -1))).alias("exhausted"),
    )
    return found, costs
