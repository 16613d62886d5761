"""Traversal, paths and communities by frontier joins over edges ``u``, ``v``.

Every level is written to the shared folder, so plans stay short and a lost
executor repeats one level.  Edges are undirected pairs of families.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.components import connected_components
from chronoloom.plans.materialize import materialize


def both_ways(edges: DataFrame) -> DataFrame:
    rows = edges.where("u is not null and v is not null and u <> v").select("u", "v")
    return rows.unionAll(rows.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int = 2, max_nodes: int | None = None) -> DataFrame:
    """``id`` and ``hop`` of all nodes within some hops of the seeds ``id``; a cap keeps the nearest, then the smallest ids."""
    near = materialize(both_ways(edges), "bfs-edges")
    seen = materialize(seeds.select("id").where("id is not null").distinct().withColumn("hop", F.lit(0)), "bfs")
    frontier = seen
    for depth in range(1, max_depth + 1):
        found = near.join(frontier.select(F.col("id").alias("u")), "u").select(F.col("v").alias("id")).distinct()
        frontier = materialize(found.join(seen, "id", "left_anti").withColumn("hop", F.lit(depth)), "bfs")
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return seen.orderBy("hop", "id").limit(max_nodes) if max_nodes else seen


def ego_network(edges: DataFrame, node: str, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``depth`` hops, and the edges among them."""
    nodes = bfs(edges, edges.sparkSession.createDataFrame([(node,)], "id string"), depth)
    inside = edges.join(nodes.select(F.col("id").alias("u")), "u", "left_semi").join(nodes.select(F.col("id").alias("v")), "v", "left_semi")
    return nodes, inside.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def shortest_paths(edges: DataFrame, source: str, target: str, max_depth: int = 6, max_paths: int = 10, separator: str | None = None) -> DataFrame:
    """All shortest paths as ``path`` arrays, in lexicographic order, up to ``max_paths``.

    With a ``separator`` that no id holds, the order is that of the joined
    texts, in which ``a10>`` comes before ``a1>``.

    Levels are found from both ends, the smaller frontier first, until they
    meet; then only nodes on a way between the ends are kept, from the meeting
    level outwards, and paths are grown over those.
    """
    spark = edges.sparkSession
    rows = edges.where("u is not null and v is not null and u <> v").select("u", "v")
    near = materialize(rows.unionAll(rows.select(F.col("v").alias("u"), F.col("u").alias("v"))), "path-edges")

    def step(level: DataFrame) -> DataFrame:
        return near.join(level.select(F.col("id").alias("u")), "u").select(F.col("v").alias("id")).distinct()

    one = lambda x: spark.createDataFrame([(x,)], "id string")
    sides = [[one(source)], [one(target)]]
    sizes, met = [1, 1], source == target
    while not met and len(sides[0]) + len(sides[1]) - 2 < max_depth:
        own, other = (0, 1) if sizes[0] <= sizes[1] else (1, 0)
        seen = sides[own][0]
        for level in sides[own][1:]:
            seen = seen.unionAll(level)
        level = materialize(step(sides[own][-1]).join(seen, "id", "left_anti"), "path-level")
        sizes[own] = level.count()
        if not sizes[own]:
            break
        sides[own].append(level)
        met = not level.join(sides[other][-1], "id", "left_semi").isEmpty()
    if not met:
        return spark.createDataFrame([], "path array<string>, length int")
    middle = sides[0][-1].join(sides[1][-1], "id", "left_semi") if source != target else sides[0][0]
    useful = [middle]
    for level in reversed(sides[0][:-1]):
        useful.insert(0, materialize(step(useful[0]).join(level, "id", "left_semi"), "path-back"))
    for level in reversed(sides[1][:-1]):
        useful.append(materialize(step(useful[-1]).join(level, "id", "left_semi"), "path-back"))
    paths = spark.createDataFrame([([source],)], "path array<string>")
    order = F.col("path") if separator is None else F.concat(F.array_join("path", separator), F.lit(separator))
    for level in useful[1:]:
        grown = paths.withColumn("u", F.element_at("path", -1)).join(near, "u").join(level.select(F.col("id").alias("v")), "v", "left_semi")
        paths = materialize(grown.select(F.concat("path", F.array("v")).alias("path")).distinct().orderBy(order).limit(max_paths), "paths")
    return paths.select("path", (F.size("path") - 1).alias("length")).orderBy(order).limit(max_paths)


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """Communities: every node takes its neighbours' most frequent label, the smallest of equals, for some rounds or until none changes."""
    near = materialize(both_ways(edges), "communities-edges")
    labels = materialize(near.select(F.col("u").alias("id")).distinct().withColumn("community_id", F.col("id")), "communities")
    for _ in range(rounds):
        votes = near.join(labels.select(F.col("id").alias("v"), "community_id"), "v").unionByName(
            labels.select(F.col("id").alias("v"), F.col("id").alias("u"), "community_id"), allowMissingColumns=True
        )
        counted = votes.groupBy("u", "community_id").agg(F.count("*").alias("n"))
        best = counted.groupBy("u").agg(F.min(F.struct((-F.col("n")).alias("n"), "community_id")).alias("m"))
        new = materialize(best.select(F.col("u").alias("id"), F.col("m.community_id").alias("community_id")), "communities")
        changed = new.join(labels.withColumnRenamed("community_id", "old"), "id").where("community_id <> old")
        labels = new
        if changed.isEmpty():
            break
    return labels


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Modularity of a labelling, from the sums of each community."""
    pairs = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
    marked = pairs.join(labels.select(F.col("id").alias("u"), F.col("community_id").alias("cu")), "u").join(labels.select(F.col("id").alias("v"), F.col("community_id").alias("cv")), "v")
    inside = marked.where("cu = cv").groupBy(F.col("cu").alias("c")).agg(F.count("*").alias("l"))
    ends = marked.select(F.explode(F.array("cu", "cv")).alias("c")).groupBy("c").agg(F.count("*").alias("d"))
    m = marked.agg(F.count("*").alias("m"))
    return ends.join(inside, "c", "left").join(F.broadcast(m)).agg(
        F.sum(F.coalesce("l", F.lit(0)) / F.col("m") - F.lit(resolution) * (F.col("d") / (2 * F.col("m"))) ** 2).alias("modularity")
    )


def modularity_search(edges: DataFrame, rounds: int = 12, levels: int = 6) -> DataFrame:
    """Communities ``id``, ``community_id`` by moves that raise the modularity, then over the graph of communities, level by level.

    In a round every second node, by a hash of the round, goes to the
    neighbouring community of the largest gain; equal gains keep it, then the
    smallest id counts.  Gains are whole decimals, so a repeated task decides
    alike.  The hash is no checksum: in a linear one, two nodes keep their
    relation in every round.  A level that doesn't raise the modularity ends the search.  Nodes of
    self links and null ends alone have no community; no edges give no rows.
    """
    whole = lambda x: x.cast("decimal(38,0)")
    links = materialize(both_ways(edges).select("u", "v", whole(F.lit(1)).alias("w")), "modularity-links")
    names = links.select(F.col("u").alias("id"), F.col("u").alias("c")).distinct()
    total = links.agg(F.sum("w")).first()[0]
    if not total:
        return names.select("id", F.col("c").alias("community_id"))
    twice = whole(F.lit(total))
    best, reached = names, None
    for _ in range(levels):
        nodes = materialize(links.groupBy("u").agg(F.sum("w").alias("k")).select(F.col("u").alias("id"), "k", F.col("u").alias("c")), "modularity")
        if reached is None:
            reached = _quality(links, nodes)
        for turn in range(rounds):
            sums = nodes.groupBy("c").agg(F.sum("k").alias("sum"))
            toward = links.where("u <> v").join(nodes.select(F.col("id").alias("v"), "c"), "v").select("u", "c", "w")
            own = nodes.select(F.col("id").alias("u"), "c", whole(F.lit(0)).alias("w"))
            options = toward.unionAll(own).groupBy("u", "c").agg(F.sum("w").alias("w"))
            rows = options.join(nodes.select(F.col("id").alias("u"), "k", F.col("c").alias("mine")), "u").join(sums, "c")
            stays = F.col("c") == F.col("mine")
            gain = whole(twice * F.col("w")) - whole(F.col("k") * (F.col("sum") - F.when(stays, F.col("k")).otherwise(whole(F.lit(0)))))
            to = rows.groupBy("u", "k", "mine").agg(F.min(F.struct((-gain).alias("loss"), (~stays).alias("moves"), "c")).alias("b"))
            awake = F.pmod(F.xxhash64(F.lit(turn), "u"), F.lit(2)) == 0
            moved = materialize(to.select(F.col("u").alias("id"), "k", F.when(awake, F.col("b.c")).otherwise(F.col("mine")).alias("c"), "b.moves"), "modularity")
            nodes = moved.select("id", "k", "c")
            if moved.where("moves").isEmpty():
                break
        value = _quality(links, nodes)
        if value <= reached:
            break
        reached = value
        names = materialize(names.select("id", F.col("c").alias("old")).join(nodes.select(F.col("id").alias("old"), "c"), "old").select("id", "c"), "modularity-names")
        best = names
        a, b = nodes.select(F.col("id").alias("u"), F.col("c").alias("cu")), nodes.select(F.col("id").alias("v"), F.col("c").alias("cv"))
        links = materialize(links.join(a, "u").join(b, "v").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")), "modularity-links")
    first = best.groupBy("c").agg(F.min("id").alias("community_id"))
    return best.join(first, "c").select("id", "community_id")


def _quality(links: DataFrame, nodes: DataFrame) -> float:
    """Modularity of weighted links, which stand in both directions, under the labels ``c``."""
    a, b = nodes.select(F.col("id").alias("u"), F.col("c").alias("cu")), nodes.select(F.col("id").alias("v"), F.col("c").alias("cv"))
    marked = links.join(a, "u").join(b, "v").groupBy("cu").agg(F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w"))).alias("inside"), F.sum("w").alias("ends"))
    m = F.sum("ends").cast("double")
    parts = marked.agg((F.coalesce(F.sum("inside").cast("double"), F.lit(0.0)) / m).alias("kept"), (F.sum(F.col("ends").cast("double") * F.col("ends").cast("double")) / m / m).alias("chance"))
    return round(parts.select(F.col("kept") - F.col("chance")).first()[0], 12)


def communities(labels: DataFrame, min_size: int = 3) -> DataFrame:
    """Communities of at least ``min_size`` members, largest first."""
    sized = labels.groupBy("community_id").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("id")).alias("members"))
    return sized.where(F.col("size") >= min_size).orderBy(F.desc("size"), "community_id")


def community_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Undirected edges with both ends in one community, once each."""
    pairs = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
    a = labels.select(F.col("id").alias("u"), "community_id")
    return pairs.join(a, "u").join(labels.select(F.col("id").alias("v"), "community_id"), ["v", "community_id"]).select("community_id", "u", "v")


def components(edges: DataFrame) -> DataFrame:
    return connected_components(edges, "u", "v")


def redirect_closure(redirects: DataFrame) -> DataFrame:
    """Final target of every source by pointer jumping; the newest redirect of a source counts.

    A source is done once its target is no source itself.  A round that finishes
    none leaves only cycles and what leads into them: those go to the smallest
    id of their component.
    """
    first = redirects.groupBy("source_family_id").agg(F.max_by("target_family_id", F.struct("updated_at", "target_family_id")).alias("t"))
    first = materialize(first.where("source_family_id <> t").select(F.col("source_family_id").alias("s"), "t"), "redirects")
    sources = first.select(F.col("s").alias("t"))
    hop, open_ = first, first.join(sources, "t", "left_semi").count()
    while open_:
        after = hop.select(F.col("s").alias("t"), F.col("t").alias("next"))
        hop = materialize(hop.join(after, "t", "left").select("s", F.coalesce("next", "t").alias("t")), "redirects")
        left = hop.join(sources, "t", "left_semi").count()
        if left == open_:
            stuck = hop.join(sources, "t", "left_semi").select("s")
            ring = connected_components(first.join(stuck, "s", "left_semi"), "s", "t")
            done = hop.join(stuck, "s", "left_anti").select("s", "t")
            hop = done.unionAll(stuck.join(ring, stuck["s"] == ring["id"]).select("s", F.col("component").alias("t")))
            break
        open_ = left
    return hop.where("s <> t").select(F.col("s").alias("source_family_id"), F.col("t").alias("target_family_id"))


def resolve(rows: DataFrame, closed: DataFrame, column: str = "family_id") -> DataFrame:
    """Replaces families by the targets of their redirects."""
    to = closed.select(F.col("source_family_id").alias(column), F.col("target_family_id").alias("_to"))
    return rows.join(to, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")
