"""Graph queries over edge tables (src, dst); newer circulars point to those they supersede."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.batches import small_partitions
from quarry.streaming.progress import discard
from quarry.streaming.progress import written_and_observed as written


#: Steps of a round's search, and written tables before they become one.
STEPS, TABLES = 8, 12
#: A frontier of so few nodes is kept on the driver and walked step by step, for so many steps, before any table of runs is made.
FEW, PLAIN = 1000, 32
#: Nodes of a run's entry.
RUN = 4
_AHEAD = [f"_{i}" for i in range(1, RUN + 1)]


def _runs(single: DataFrame) -> DataFrame:
    """(side, src, _1 to _4) of single steps (side, src, dst): the next nodes, null beyond a run's end."""
    of = lambda df, **names: df.select("side", *(F.col(c).alias(n) for n, c in names.items()))
    two = of(single, src="src", _1="dst").join(of(single, _1="src", _2="dst"), ["side", "_1"], "left")
    return two.join(of(two, _2="src", _3="_1", _4="_2"), ["side", "_2"], "left").select("side", "src", *_AHEAD)


def _walked(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(side, start, node) of all nodes on paths of a side's edges (side, src, dst) from its starts (side, node).

    A search from a frontier.  A few nodes are walked step by step over the edges as they are.  Then a round takes STEPS steps from nodes that were new in the round before, and
    keeps what was not seen.  Nodes with one edge out form runs, which are not walked step by step: tables
    of what lies RUN, RUN^2, ... single steps ahead give a run of thousands of nodes in a few joins.  No
    table is larger than the edges or the result, whatever hubs there are.
    """
    small_partitions(edges.sparkSession)
    keys = ["side", "start", "node"]
    first, size = written(starts.select("side", F.col("node").alias("start"), "node").distinct(), rows=F.count("*"))
    seen, frontier = [first], first
    if size["rows"] <= FEW:
        found = new = {tuple(r) for r in first.collect()}
        steps = written(edges.select("side", F.col("src").alias("node"), "dst").where("node <> dst"))[0]
        local = lambda rows: edges.sparkSession.createDataFrame(list(rows), first.schema)
        for _ in range(PLAIN):
            next_ = steps.join(F.broadcast(local(new)), ["side", "node"]).select("side", "start", "dst").distinct().limit(FEW + 1).collect()
            if len(next_) > FEW:
                break
            new = {tuple(r) for r in next_} - found
            found = found | new
            if not new:
                break
        discard(steps)
        if not new:
            return local(found)
        seen, frontier = [written(local(found))[0]], local(new)

    def unseen(rows: DataFrame) -> tuple[DataFrame, dict]:
        return written(rows.join(reduce(DataFrame.unionByName, seen), keys, "left_anti"), rows=F.count("*"))

    ends, kinds = written(edges.where("src <> dst").groupBy("side", "src").agg(F.min("dst").alias("dst"), F.max("dst").alias("_last")), single=F.count_if(F.col("dst") == F.col("_last")), fork=F.count_if(F.col("dst") != F.col("_last")))
    single, forks = ends.where("dst = _last").drop("_last"), ends.where("dst <> _last").select("side", F.col("src").alias("node"))
    runs, entries, hops = [], kinds["single"], None

    while True:
        reached, level = frontier, 0
        while level < len(runs) or (entries and RUN**level <= kinds["single"]):
            # reached: what lies within RUN^level - 1 single steps
            if level == len(runs):
                ahead = single if not level else runs[-1].where(f"{_AHEAD[-1]} is not null").select("side", "src", F.col(_AHEAD[-1]).alias("dst"))
                table, full = written(_runs(ahead), full=F.count(_AHEAD[-1]))
                runs.append(table)
                entries = full["full"]  # none: no run goes on
            found = reached.join(runs[level].withColumnRenamed("src", "node"), ["side", "node"])
            ahead = F.explode(F.array_compact(F.array(*_AHEAD[:-1])))
            new, count = unseen(found.select("side", "start", ahead.alias("node")).distinct())
            if not count["rows"]:
                break
            seen.append(new)
            reached, level = reached.unionByName(new), level + 1
        if not kinds["fork"]:
            break
        if hops is None:
            hops = written(edges.select("side", F.col("src").alias("node"), "dst").where("node <> dst").distinct())[0]
        step, steps = reached.join(forks, ["side", "node"], "left_semi").select(keys), []
        for i in range(STEPS):
            step = step.join(hops, ["side", "node"]).select("side", "start", F.col("dst").alias("node")).distinct()
            steps.append(step.withColumn("_step", F.lit(i)))
        new, count = unseen(reduce(DataFrame.unionByName, steps).groupBy(keys).agg(F.min("_step").alias("_step")))
        if not count["rows"]:
            break
        seen.append(new.select(keys))
        frontier = new.where(F.col("_step") == STEPS - 1).select(keys)
        if len(seen) > TABLES:
            seen = [written(reduce(DataFrame.unionByName, seen))[0]]
    discard(ends, *runs, *([hops] if hops is not None else []))
    return reduce(DataFrame.unionByName, seen)


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node) of all nodes on paths from each start, which is included."""
    side = lambda df: df.withColumn("side", F.lit(0))
    return _walked(side(edges), side(starts)).select("start", "node")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def walked(supersedes: DataFrame, starts: DataFrame) -> DataFrame:
    """(side, start, node) of both directions: what a circular supersedes (0) and what supersedes it (1)."""
    both = supersedes.select(F.lit(0).alias("side"), "src", "dst").unionByName(reverse(supersedes).select(F.lit(1).alias("side"), "src", "dst"))
    return _walked(both, starts.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), "node"))


def chain(supersedes: DataFrame, starts: DataFrame, walk: DataFrame | None = None) -> DataFrame:
    """(start, node): all that a circular supersedes and all that supersedes it, itself included.

    walk: of walked(), if there is one already."""
    walk = walked(supersedes, starts) if walk is None else walk
    return walk.select("start", "node").distinct()


def latest(supersedes: DataFrame, starts: DataFrame, nodes: DataFrame, walk: DataFrame | None = None) -> DataFrame:
    """(start, latest): a version above it that nothing supersedes, the last by date and id, or itself.

    nodes: (node, date); walk: of walked(), if there is one already.
    """
    above = reachable(reverse(supersedes), starts) if walk is None else walk.where("side = 1").select("start", "node")
    top = above.join(supersedes.select(F.col("dst").alias("node")), "node", "left_anti").join(nodes, "node")
    best = top.groupBy("start").agg(F.max_by("node", F.struct("date", "node")).alias("latest"))
    return starts.select(F.col("node").alias("start")).join(best, "start", "left").select("start", F.coalesce("latest", "start").alias("latest"))


def related(start: int, links: list[DataFrame], nodes: DataFrame, k: int = 10) -> DataFrame:
    """Other circulars with a neighbour in common, newest first."""
    out = None
    for e in links:
        own = e.where(F.col("src") == start).select("dst").distinct()
        other = e.join(own, "dst", "left_semi").where(F.col("src") != start).select(F.col("src").alias("node"))
        out = other if out is None else out.unionByName(other)
    return nodes.join(out.distinct(), "node", "left_semi").orderBy(F.desc_nulls_first("date"), "node").limit(k)


def freshness(wanted: DataFrame, nodes: DataFrame, supersedes: DataFrame) -> DataFrame:
    """(node, is_latest, superseded_by) of those that exist; the greatest of several newer ones."""
    newer = supersedes.groupBy(F.col("dst").alias("node")).agg(F.max("src").alias("superseded_by"))
    return wanted.join(nodes.select("node"), "node").join(newer, "node", "left").select("node", F.col("superseded_by").isNull().alias("is_latest"), "superseded_by")


def impact(wanted: DataFrame, applies_to: DataFrame, amends: DataFrame) -> DataFrame:
    """Entities and amended regulations of each circular, distinct and sorted."""
    sets = lambda e, name: e.join(wanted, e["src"] == wanted["node"], "left_semi").groupBy(F.col("src").alias("node")).agg(F.array_join(F.sort_array(F.collect_set("dst")), ",").alias(name))
    return wanted.join(sets(applies_to, "entities"), "node", "left").join(sets(amends, "regulations"), "node", "left").fillna("")


def source_summary(nodes: DataFrame, about: DataFrame, source: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Circulars of a source, whatever its case, within dates, with their topics."""
    rows = nodes.where(F.lower("source") == source.lower())
    rows = rows.where(F.col("date") >= since) if since else rows
    rows = rows.where(F.col("date") <= until) if until else rows
    topics = about.groupBy(F.col("src").alias("node")).agg(F.array_join(F.sort_array(F.collect_set("dst")), ",").alias("topics"))
    return rows.join(topics, "node", "left").fillna("", ["topics"])


def by_topic(nodes: DataFrame, about: DataFrame, name: str, each: int | None = None) -> DataFrame:
    """Circulars of topics whose name contains a text, by source, newest first; up to ``each`` of a source."""
    found = about.where(F.contains(F.lower("dst"), F.lit(name.lower()))).select(F.col("src").alias("node")).distinct()
    rows = nodes.join(found, "node", "left_semi")
    if each is None:
        return rows
    w = Window.partitionBy("source").orderBy(F.desc_nulls_first("date"), "node")
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= each)


def under_entity(is_a: DataFrame, entity: str, applies_to: DataFrame, k: int | None = 20) -> DataFrame:
    """(src, dst) of circulars that apply to an entity or one below it; is_a points from child to parent."""
    start = is_a.sparkSession.createDataFrame([(entity,)], "node string")
    below = reachable(reverse(is_a), start).select(F.col("node").alias("dst"))
    out = applies_to.join(below, "dst").select("src", "dst").distinct()
    return out if k is None else out.orderBy("src", "dst").limit(k)


def stats(nodes: DataFrame, **edges: DataFrame) -> DataFrame:
    """One row: number of nodes and of edges of each kind."""
    kinds = [nodes.select(F.lit("nodes").alias("kind")), *(e.select(F.lit(k).alias("kind")) for k, e in edges.items())]
    all_ = kinds[0]
    for k in kinds[1:]:
        all_ = all_.unionByName(k)
    return all_.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ["nodes", *edges]))


def group_chunks(chunks: DataFrame, number: str, order: str, most: int = 5) -> DataFrame:
    """One circular for each number: longest title (the first of equals), earliest non-empty date,
    the first texts in scan order, source and link of the first chunk."""
    rows = chunks.where(F.trim(F.coalesce(number, F.lit(""))) != "").withColumn("number", F.trim(number))
    w = Window.partitionBy("number").orderBy(order)
    near = rows.withColumn("_rn", F.row_number().over(w)).withColumn("text", F.when(F.col("_rn") <= most, F.col("text")))
    return near.groupBy("number").agg(
        F.max_by("title", F.struct(F.length("title").alias("n"), (-F.col("_rn")).alias("p"))).alias("title"),
        F.min(F.nullif(F.col("date"), F.lit(""))).alias("date"),
        F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("_rn", "text")))).getField("text").alias("texts"),
        F.min_by("source", "_rn").alias("source"),
        F.min_by("link", "_rn").alias("link"),
    )


def canonical(names: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Names by their canonical form where the alias table (alias, canonical) has one, whatever the case."""
    known = aliases.select(F.lower("alias").alias("_a"), "canonical").dropDuplicates(["_a"])
    return names.join(known, F.lower(names[column]) == F.col("_a"), "left").withColumn(column, F.coalesce("canonical", column)).drop("_a", "canonical")


def from_obligations(obligations: DataFrame) -> dict[str, DataFrame]:
    """Edges from extracted obligations: supersedes, amends, applies_to (explode of typed arrays)."""
    number = F.col("extraction.circular_reference").alias("src")
    take = lambda field, name: obligations.select(number, F.explode(f"extraction.{field}").alias("x")).select("src", F.col(f"x.{name}").alias("dst")).where("src is not null and dst is not null and dst <> ''").distinct()
    return {"supersedes": take("supersedes", "circular_reference"), "amends": take("amendments_to", "regulation_name"), "applies_to": take("applies_to", "entity_type")}
