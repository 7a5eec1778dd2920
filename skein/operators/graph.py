"""Entity and relation graphs: extraction, merging, expansion, communities, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from skein.functions.text import jaccard, tokens
from skein.operators.budget import fill_budget as fill_budget
from skein.operators.components import connected_components
from skein.operators.running import in_ranges, running
from skein.operators.search import similar_pairs
from skein.session import Scratch, cut_lineage

ENTITY = r"\b([A-Z][a-z]+(?:\s[A-Z][a-z]+){1,3})\b"


def light_entities(docs: DataFrame, id_col: str = "id", text_col: str = "text", most: int = 20) -> DataFrame:
    """(chunk_id, name, type): capitalised phrases of two to four words, the first ``most``
    different ones of a text in order of their first place."""
    names = F.transform(F.regexp_extract_all(text_col, F.lit(ENTITY), F.lit(1)), lambda n: F.regexp_replace(n, r"\s", " "))
    keys = F.transform(names, lambda n: F.lower(n))
    firsts = F.filter(names, lambda n, i: F.array_position(keys, F.lower(n)) == i + 1)
    return docs.select(F.col(id_col).alias("chunk_id"), F.explode(F.slice(firsts, 1, most)).alias("name")).withColumn(
        "type", F.lit("CONCEPT")
    )


def parse_entities(lines: DataFrame, most: int = 20) -> DataFrame:
    """``name | TYPE | description`` lines of (chunk_id, output) to (chunk_id, name, type, description)."""
    parts = F.transform(F.split("line", r"\|"), lambda p: F.trim(p))
    rows = lines.select("chunk_id", F.posexplode(F.split("output", "\n")).alias("pos", "line"))
    rows = rows.withColumn("p", parts).where((F.size("p") >= 2) & (F.get("p", F.lit(0)) != ""))
    order = Window.partitionBy("chunk_id").orderBy("pos")
    return (
        rows.withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= most)
        .select(
            "chunk_id",
            F.get("p", F.lit(0)).alias("name"),
            F.upper(F.get("p", F.lit(1))).alias("type"),
            F.coalesce(F.get("p", F.lit(2)), F.lit("")).alias("description"),
        )
    )


def parse_relations(lines: DataFrame, most: int = 15) -> DataFrame:
    """``subject | RELATION | object | description | strength`` lines; strength is 1 to 10, 5 if missing."""
    parts = F.transform(F.split("line", r"\|"), lambda p: F.trim(p))
    rows = lines.select("chunk_id", F.posexplode(F.split("output", "\n")).alias("pos", "line"))
    rows = rows.withColumn("p", parts).where(F.size("p") >= 3)
    order = Window.partitionBy("chunk_id").orderBy("pos")
    strength = F.coalesce(F.expr("try_cast(get(p, 4) AS DOUBLE)"), F.lit(5.0))
    return (
        rows.withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= most)
        .select(
            "chunk_id",
            F.lower(F.get("p", F.lit(0))).alias("src"),
            F.get("p", F.lit(1)).alias("relation"),
            F.lower(F.get("p", F.lit(2))).alias("target"),
            F.coalesce(F.get("p", F.lit(3)), F.lit("")).alias("description"),
            F.least(F.lit(10.0), F.greatest(F.lit(1.0), strength)).alias("strength"),
        )
    )


def merge_entities(mentions: DataFrame) -> DataFrame:
    """(entity, type, frequency): mentions by lower-cased name; the type of the least chunk that
    knows one, the number of different chunks."""
    named = mentions.withColumn("entity", F.lower(F.trim("name")))
    known = F.when(F.col("type") != "UNKNOWN", F.struct("chunk_id", "type"))
    return named.groupBy("entity").agg(
        F.coalesce(F.min(known)["type"], F.lit("UNKNOWN")).alias("type"),
        F.count_distinct("chunk_id").alias("frequency"),
    )


def merge_relations(relations: DataFrame) -> DataFrame:
    """(src, target, relation, weight, support_count, text_units): strengths summed.

    A task holds every different relation and chunk of its rows. Large tables come dealt by chunk, in
    as many parts as ``batches.parts_of`` tells: they are merged there, without another shuffle.
    """
    return relations.groupBy("src", "target", "relation").agg(
        F.sum("strength").alias("weight"),
        F.count(F.lit(1)).alias("support_count"),
        F.count_distinct("chunk_id").alias("text_units"),
    )


def with_stub_nodes(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities and every end of a relation that is none yet."""
    ends = relations.select(F.col("src").alias("entity")).union(relations.select("target")).distinct()
    stubs = ends.join(entities, "entity", "left_anti")
    return entities.unionByName(
        stubs.withColumn("type", F.lit("UNKNOWN")).withColumn("frequency", F.lit(0).cast("long"))
    )


def degrees(relations: DataFrame) -> DataFrame:
    """(entity, out_degree, in_degree, degree)."""
    ends = relations.select(F.col("src").alias("entity"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(
        relations.select("target", F.lit(0), F.lit(1))
    )
    return ends.groupBy("entity").agg(
        F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), (F.sum("o") + F.sum("i")).alias("degree")
    )


def entity_matches(query_entities: DataFrame, entities: DataFrame, floor: float = 0.4) -> DataFrame:
    """(query_id, entity, score): Jaccard of name words at least ``floor``; equal names are 1, and
    of two one-word names only equal ones match. Candidates share a word: an equi-join."""
    q = query_entities.select("query_id", F.lower("name").alias("asked")).distinct()
    q = q.withColumn("qt", F.array_distinct(tokens(F.col("asked"))))
    e = entities.select("entity").withColumn("et", F.array_distinct(tokens(F.col("entity"))))
    pairs = (
        q.withColumn("w", F.explode("qt")).join(e.withColumn("w", F.explode("et")), "w").drop("w").distinct()
    )
    same = F.col("asked") == F.col("entity")
    single = (F.size("qt") == 1) & (F.size("et") == 1)
    score = F.when(same, 1.0).when(single, 0.0).otherwise(jaccard(F.col("qt"), F.col("et")))
    return (
        pairs.withColumn("score", F.round(score, 6))
        .where(F.col("score") >= floor)
        .groupBy("query_id", "entity")
        .agg(F.max("score").alias("score"))
    )


def hops(edges: DataFrame, seeds: DataFrame, most: int = 2, directed: bool = False) -> DataFrame:
    """(query_id, node, hop): the least number of steps from a query's seeds, up to ``most``.

    Each step joins the frontier alone and drops what was visited; steps go through checkpoints.
    """
    pairs = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    if not directed:
        pairs = pairs.union(pairs.select(F.col("next"), F.col("node"))).distinct()
    visited = cut_lineage(seeds.select("query_id", "node").distinct().withColumn("hop", F.lit(0)))
    frontier = visited
    for step in range(1, most + 1):
        reached = frontier.join(pairs, "node").select("query_id", F.col("next").alias("node")).distinct()
        frontier = cut_lineage(
            reached.join(visited, ["query_id", "node"], "left_anti").withColumn("hop", F.lit(step))
        )
        if frontier.isEmpty():
            break
        visited = visited.union(frontier)
    return visited


def expand_results(
    base: DataFrame, matches: DataFrame, edges: DataFrame, mentions: DataFrame, k: int = 10,
    most: int = 2, decay: float = 0.7,
) -> DataFrame:
    """(query_id, id, score) of chunks that the graph adds to ``base``: chunks of a matched entity
    score .5 + .3 * match, those of an entity ``h`` hops on .8 * decay**h; the best score counts."""
    near = hops(edges, matches.select("query_id", F.col("entity").alias("node")), most)
    direct = matches.select("query_id", F.col("entity").alias("node"), (0.5 + 0.3 * F.col("score")).alias("s"))
    further = near.where("hop > 0").select("query_id", "node", (0.8 * F.pow(F.lit(decay), "hop")).alias("s"))
    chunks = mentions.select(F.col("entity").alias("node"), F.col("chunk_id").alias("id"))
    scored = (
        direct.union(further)
        .join(chunks, "node")
        .groupBy("query_id", "id")
        .agg(F.round(F.max("s"), 6).alias("score"))
        .join(base, ["query_id", "id"], "left_anti")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Nodes of a graph that each round of ``communities`` looks at as a whole.
SMALL = 100_000
#: A larger graph is left for the part around the nodes that would move once they are under one in SHARE.
SHARE = 8
#: Neighbours of a node whose votes one task takes as they are.
HUB = 10_000


def communities(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, community) by weighted label propagation until no node would rather move.

    A node would move if a neighbouring label has more weight among its neighbours than its own
    (the heaviest, of equals the least). In a round half of those nodes move, by hash; if that does
    not raise the weight within communities, only nodes move that come before all their
    neighbours who would move too. Such a round always raises it, so the rounds end.

    A round is one pass, which tells the weight within communities after it and the next wishes.
    The nodes that would move halve from round to round: once they are few, rounds go over them and
    their neighbours alone (``around``), for what others would do does not change.

    It stands for modularity search, whose greedy moves are sequential over the whole graph. Loops
    are ignored; an edge given twice counts with both weights.
    """
    scratch = Scratch(edges.sparkSession, "communities")
    weight = F.col("weight").cast("double").alias("weight")
    there, back = F.struct("src", "dst", weight), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), weight)
    pairs = edges.where("src <> dst").select(F.inline(F.array(there, back)))
    both = scratch.put("edges", pairs.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    seen = Observation()
    alone = both.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n")).observe(seen, F.max("n").alias("most"))
    alone = scratch.put("alone", alone.select("node", F.col("node").alias("community"), F.lit(True).alias("asked"), F.lit(True).alias("inner")))
    hubs = (seen.get["most"] or 0) > HUB
    state, told = noted(scratch, both, alone, 0, hubs)
    return settled(both, state, told, 0, small, hubs)[0].select("node", "community")


def settled(both: DataFrame, state: DataFrame, told: dict, step: int, small: int, hubs: bool) -> tuple[DataFrame, dict, int]:
    """The state after rounds from ``step`` on, its counts and the next step: when no node would move, or
    one would that has neighbours who are not asked."""
    scratch = Scratch(both.sparkSession, "communities")
    while told["open"] and not told["outer"]:
        if told["nodes"] > small and told["open"] * SHARE < told["nodes"]:
            part, seen = around(scratch, both, state, step)
            if seen["nodes"] * 2 < told["nodes"]:
                part, _, step = settled(*part, seen, step, small, hubs)
                state, told = merged(scratch, state, part, step)
                continue
        after = None
        if told["half"]:
            new, after = noted(scratch, both, moved(state, F.col("wished").isNotNull() & coin(step)), step + 1, hubs)
        if after is None or after["inside"] <= told["inside"]:
            free = scratch.put("free", free_movers(both, state, step))
            goes = F.coalesce("free", F.lit(False))
            new, after = noted(scratch, both, moved(state.join(free, "node", "left"), goes), step + 1, hubs)
        state, told, step = new, after, step + 1
    return state, told, step


def turn_of(step: int) -> Column:
    # a struct is no constant in the compiled code, which all rounds so share; the hash is the same
    return F.xxhash64("node", F.struct(F.lit(step)))


def coin(step: int) -> Column:
    return F.pmod(turn_of(step), F.lit(2)) == 0


def moved(state: DataFrame, goes: Column) -> DataFrame:
    label = F.when(goes, F.col("wished")).otherwise(F.col("community"))
    return state.select("node", label.alias("community"), "asked", "inner")


def noted(scratch: Scratch, both: DataFrame, labels: DataFrame, step: int, hubs: bool) -> tuple[DataFrame, dict]:
    """The state that ``labels`` lead to, written, and its counts."""
    return written(scratch, "state", wishes(both, labels, hubs), step)


def written(scratch: Scratch, name: str, state: DataFrame, step: int) -> tuple[DataFrame, dict]:
    """The state (node, community, asked, inner, own, wished) written, and its counts: nodes, those that
    would move, those of them outside the inner ones, the half that may in the round ``step``, and
    the weight within communities."""
    seen = Observation()
    wishing = F.col("wished").isNotNull()
    state = state.observe(
        seen,
        F.count_if("asked").alias("nodes"),
        F.count_if(wishing).alias("open"),
        F.count_if(wishing & ~F.col("inner")).alias("outer"),
        F.count_if(wishing & coin(step)).alias("half"),
        F.coalesce(F.round(F.sum("own"), 6), F.lit(0.0)).alias("inside"),
    )
    return scratch.put(name, state), seen.get


def wishes(both: DataFrame, labels: DataFrame, hubs: bool) -> DataFrame:
    """The state of (node, community, asked, inner): the weight of a node's own label, and a label with
    more if there is one. ``both`` holds the edges of the nodes asked, all of them; others keep their label.

    A node's own label is a vote of no weight. Votes are dealt by node; with ``hubs`` they are added
    up in each task first, so that a hub's are never dealt to one.
    """
    far = labels.select(F.col("node").alias("dst"), F.col("community").alias("label"))
    none = F.lit(None).cast("boolean")
    votes = both.join(far, "dst").select(F.col("src").alias("node"), "label", "weight", none.alias("asked"), none.alias("inner"), F.lit(True).alias("near"))
    votes = votes.union(labels.select("node", "community", F.lit(0.0), "asked", "inner", F.lit(False)))
    votes = votes if hubs else votes.repartition("node")
    votes = votes.groupBy("node", "label").agg(
        F.round(F.sum("weight"), 6).alias("w"), F.max("asked").alias("asked"), F.max("inner").alias("inner"), F.max("near").alias("near")
    )
    mine = F.col("asked").isNotNull()
    told = votes.groupBy("node").agg(
        F.max(F.when(mine, F.col("label"))).alias("community"),
        F.max("asked").alias("asked"),
        F.max("inner").alias("inner"),
        F.max(F.when(mine, F.col("w"))).alias("own"),
        F.min(F.when(F.col("near"), F.struct((-F.col("w")).alias("w"), "label"))).alias("best"),
    )
    wished = F.when(-F.col("best.w") > F.col("own"), F.col("best.label"))
    return told.select("node", "community", "asked", "inner", "own", wished.alias("wished"))


def free_movers(both: DataFrame, state: DataFrame, step: int) -> DataFrame:
    """(node, free) of the nodes that would move and come before all their neighbours who would."""
    movers = state.where("wished IS NOT NULL").select("node", F.struct(turn_of(step), "node").alias("turn"))
    others = both.join(movers.select(F.col("node").alias("dst"), F.col("turn").alias("other")), "dst")
    others = others.groupBy(F.col("src").alias("node")).agg(F.max("other").alias("other"))
    free = movers.join(others, "node", "left").where("other IS NULL OR turn > other")
    return free.select("node", F.lit(True).alias("free"))


def around(scratch: Scratch, both: DataFrame, state: DataFrame, step: int) -> tuple[tuple[DataFrame, DataFrame], dict]:
    """The part of a graph around the nodes that would move: their edges and their neighbours', the
    state of the ends, and its counts. The movers are inner nodes: all their neighbours are asked."""
    movers = scratch.put("movers", state.where("wished IS NOT NULL").select("node", F.lit(True).alias("inner")))
    near = both.join(movers.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"))
    asked = near.withColumn("inner", F.lit(False)).union(movers).groupBy("node").agg(F.max("inner").alias("inner"))
    asked = scratch.put("asked", asked)
    own = Scratch(both.sparkSession, "around")
    edges = own.put("edges", both.join(asked.select(F.col("node").alias("src")), "src", "left_semi"))
    rim = edges.select(F.col("dst").alias("node"), F.lit(None).cast("boolean").alias("inner")).union(asked)
    rim = scratch.put("ends", rim.groupBy("node").agg(F.max("inner").alias("here")))
    here = F.col("here").isNotNull()
    ends = state.join(rim, "node").select(
        "node", "community", here.alias("asked"), F.coalesce("here", F.lit(False)).alias("inner"),
        F.when(here, F.col("own")).alias("own"), "wished",
    )
    ends, seen = written(own, "state", ends, step)
    return (edges, ends), seen


def merged(scratch: Scratch, state: DataFrame, part: DataFrame, step: int) -> tuple[DataFrame, dict]:
    """The state with that of a part of the nodes."""
    new = scratch.put("part", part.where("asked").select("node", *[F.col(c).alias(f"{c}_now") for c in ("community", "own", "wished")]))
    now = {c: F.when(F.col("community_now").isNotNull(), F.col(f"{c}_now")).otherwise(F.col(c)).alias(c) for c in ("community", "own", "wished")}
    whole = state.join(new, "node", "left").select("node", now["community"], "asked", "inner", now["own"], now["wished"])
    return written(scratch, "state", whole, step)


def largest_component(edges: DataFrame) -> DataFrame:
    """The edges (src, dst, ...) of the largest connected component; of equals that of the least node."""
    groups = connected_components(edges)
    sizes = groups.groupBy("component").count()
    head = sizes.orderBy(F.desc("count"), "component").limit(1).select("component")
    nodes = groups.join(F.broadcast(head), "component").select(F.col("node").alias("src"))
    return edges.join(nodes, "src", "left_semi")


def hierarchical_communities(edges: DataFrame, most: int = 10, levels: int = 4) -> DataFrame:
    """(node, level, community): communities, and those of over ``most`` nodes split again by
    their inner edges alone, ``levels`` deep at most. A finer community's name starts with that of
    the community it is part of; one that no longer splits keeps it."""
    scratch = Scratch(edges.sparkSession, "nested")
    inner = scratch.put("links", edges.select("src", "dst", "weight"))
    current = communities(inner).select("node", F.col("community").cast("string").alias("community"))
    found = current.withColumn("level", F.lit(0))
    for level in range(1, levels):
        big = current.groupBy("community").count().where(F.col("count") > most).select("community")
        big = scratch.put("big", big)
        if big.isEmpty():
            break
        # communities only split, so the edges within the larger ones hold all that later levels need
        a = current.join(big, "community", "left_semi").select(F.col("node").alias("src"), F.col("community").alias("a"))
        b = current.select(F.col("node").alias("dst"), F.col("community").alias("b"))
        inner = inner.join(a, "src").join(b, "dst").where("a = b").select("src", "dst", "weight", "a")
        inner = scratch.put("links", inner)
        # within a community all edges bind: those lighter than its mean are left out
        mean = inner.groupBy("a").agg(F.avg("weight").alias("mean"))
        inner, kept = inner.drop("a"), inner.join(mean, "a").where("weight >= mean").select("src", "dst", "weight")
        finer = communities(kept).withColumnRenamed("community", "part")
        name = F.when(F.col("part").isNotNull(), F.concat_ws("/", "community", "part")).otherwise(F.col("community"))
        # every level stays: the result reads them all
        current = scratch.put(f"level{level}", current.join(finer, "node", "left").select("node", name.alias("community")))
        found = found.unionByName(current.withColumn("level", F.lit(level)))
    return found.select("node", "level", "community")


def member_hash(labels: DataFrame) -> DataFrame:
    """(level, community, size, member_hash): a hash of the level and the set of members, made of
    sums of the members' hashes, so that a community of any size is summed and never gathered."""
    node = F.md5(F.col("node").cast("string"))
    lanes = [F.sum(F.conv(F.substring(node, 1 + 8 * k, 8), 16, 10).cast("long")).cast("string") for k in range(4)]
    summed = labels.groupBy("level", "community").agg(F.count(F.lit(1)).alias("size"), F.concat_ws("-", *lanes).alias("lanes"))
    whole = F.md5(F.concat_ws("|", F.col("level").cast("string"), "lanes"))
    return summed.select("level", "community", "size", whole.alias("member_hash"))


def top_communities(sizes: DataFrame, least: int = 3, most: int = 15) -> DataFrame:
    """The ``most`` largest communities of each level (level, community, size) that have at least
    ``least`` members, with their rank; the others get a template instead of a model's summary."""
    order = Window.partitionBy("level").orderBy(F.desc("size"), "community")
    ranked = sizes.where(F.col("size") >= least).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= most)


def reports_of_level(reports: DataFrame, level: int) -> DataFrame:
    """The reports of a level, or all where that level has none."""
    some = reports.where(F.col("level") == level).select(F.lit(True).alias("some")).limit(1)
    joined = reports.join(F.broadcast(some), F.lit(True), "left")
    return joined.where(F.col("some").isNull() | (F.col("level") == level)).drop("some")


def reports_to_index(reports: DataFrame, indexed: DataFrame) -> DataFrame:
    """(id, text, level, title): non-empty reports (key, text, level, title, member_hash) whose
    member hash differs from that of their last indexing (key, indexed_hash)."""
    told = reports.where(F.coalesce("text", F.lit("")) != "").join(indexed, "key", "left")
    new = told.where(F.col("indexed_hash").isNull() | (F.col("indexed_hash") != F.col("member_hash")))
    return new.select(F.concat(F.lit("__community__"), "key").alias("id"), "text", "level", "title")


def shuffled(rows: DataFrame, seed: int = 42, key: str = "id") -> DataFrame:
    """Rows with their place in an order that depends on ``seed`` and their key alone."""
    from skein.functions.text import seeded

    return rows.withColumn("turn", seeded(F.col(key), seed))


def graph_status(entities: DataFrame, relations: DataFrame, labels: DataFrame, reports: DataFrame) -> DataFrame:
    """One row: entities, relations, communities, community_summaries."""
    counts = [
        entities.agg(F.count(F.lit(1)).alias("entities")),
        relations.agg(F.count(F.lit(1)).alias("relations")),
        labels.agg(F.count_distinct("community").alias("communities")),
        reports.agg(F.count(F.lit(1)).alias("community_summaries")),
    ]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2]).crossJoin(counts[3])


def filter_nodes(nodes: DataFrame, types: tuple[str, ...] = (), least_degree: int = 0, limit: int | None = None) -> DataFrame:
    """Nodes (id, type, degree, ...) of the given types and at least a degree; ``limit`` is a
    viewer's and takes them by degree, then id."""
    kept = nodes.where(F.col("type").isin(*types)) if types else nodes
    kept = kept.where(F.col("degree") >= least_degree)
    return kept if limit is None else kept.orderBy(F.desc("degree"), "id").limit(limit)


def node_evidence(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(entity, chunk_id, source, excerpt): the known chunks of each entity, 200 characters of each."""
    told = chunks.select(F.col("id").alias("chunk_id"), "source", F.substring("text", 1, 200).alias("excerpt"))
    named = mentions.select(F.lower(F.trim("name")).alias("entity"), "chunk_id").distinct()
    return named.join(told, "chunk_id").select("entity", "chunk_id", "source", "excerpt")


def parent_communities(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """(community, parent): the coarse community of most of its nodes, the least of equals."""
    votes = (
        fine.join(coarse.withColumnRenamed("community", "parent"), "node")
        .groupBy("community", "parent")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    order = Window.partitionBy("community").orderBy(F.desc("n"), "parent")
    return votes.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("community", "parent")


def community_sizes(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, size, internal_edges)."""
    a = labels.select(F.col("node").alias("src"), F.col("community"))
    b = labels.select(F.col("node").alias("dst"), F.col("community").alias("other"))
    inside = (
        edges.join(a, "src").join(b, "dst").where("community = other").groupBy("community").agg(F.count(F.lit(1)).alias("internal_edges"))
    )
    sizes = labels.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(inside, "community", "left").fillna({"internal_edges": 0})


def community_template(labels: DataFrame, names: int = 5) -> DataFrame:
    """(community, summary): the number of members and the first names in order.

    The names are limited in each task, so a community of any size is never gathered.
    """
    order = Window.partitionBy("community").orderBy("node")
    first = labels.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= names)
    listed = first.groupBy("community").agg(F.array_join(F.array_sort(F.collect_list("node")), ", ").alias("names"))
    sizes = labels.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    more = F.when(F.col("size") > names, F.concat(F.lit(" (+"), F.col("size") - names, F.lit(" more)"))).otherwise("")
    text = F.concat(F.lit("A cluster of "), F.col("size"), F.lit(" entities: "), "names", more, F.lit("."))
    return sizes.join(listed, "community").select("community", "size", text.alias("summary"))


def alias_groups(vectors: DataFrame, floor: float = 0.92) -> DataFrame:
    """(node, component) of entities (id, embedding) linked by a cosine of at least ``floor``."""
    return connected_components(similar_pairs(vectors, floor, forest=True))


def graph_payload(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, val) and links (source, target, relation, value, width) for a viewer; both
    ends of a link are nodes."""
    nodes = entities.select(
        F.col("entity").alias("id"),
        F.substring("entity", 1, 24).alias("label"),
        (4 + F.least("frequency", F.lit(18))).alias("val"),
    )
    ids = nodes.select("id")
    links = (
        relations.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
        .join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
        .select(
            F.col("src").alias("source"), "target", "relation", F.col("weight").alias("value"), (1 + F.col("weight") / 8).alias("width")
        )
        .dropDuplicates(["source", "target", "relation"])
    )
    return nodes, links


def prefix_budget(rows: DataFrame, budget: int, cost: Column) -> DataFrame:
    """Rows of each query in rank order up to the first that would pass the budget. Costs are not
    negative; a query may have any share of the rows, its ranks are summed in ranges."""
    ranged = in_ranges(rows, ["query_id"], ["rank"])
    spent = running(ranged, ["query_id"], ["rank"], "spent", cost)
    return spent.where(F.col("spent") <= budget).drop("_range")
