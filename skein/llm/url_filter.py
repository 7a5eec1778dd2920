"""URL judgement: longest matching rule first, else a per-host tree of path templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.components import hot_keys, lookup
from skein.session import cut_lineage

#: Levels of the tree; what a path has beyond them is one wildcard, ``**``.
LEVELS = 4
#: A node with more different segments than this has variable ones: those under its mean count.
MANY = 12
#: Pseudo-pages of a parent's purity, and of the same branch's over all hosts.
STRENGTH = 2.0
#: Rows of one partition of a level's tables.
PART_ROWS = 5000
#: Two branches are alike unless their purities differ by so many standard errors.
Z = 1.96
#: A branch with fewer labelled pages, its own or else those of its name over all hosts, is unknown.
LEAST_LABELS = 5

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null, empty or without ``://``. Any other
    text is taken as it is, whatever its length."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), *LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[0]) | host.endswith("." + rule[0])) & path.startswith(rule[1])


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule (ties: the alphabetically first), or null where
    none fits, as none does an empty host. ``rules`` may be empty."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]), reverse=True):
        hit = fits(host, path, rule)
        name = F.when(hit, F.lit(rule[0] + rule[1])).otherwise(name)
        verdict = F.when(hit, F.lit(rule[2])).otherwise(verdict)
    return name, verdict


def path_tree(
    leaves: DataFrame,
    levels: int = LEVELS,
    many: int = MANY,
    strength: float = STRENGTH,
    z: float = Z,
    least: int = LEAST_LABELS,
) -> DataFrame:
    """(key, template, purity) of each of ``leaves`` (key, host, path, n, bad), which are different
    paths of hosts with their labelled pages ``n`` and the ``bad`` ones among them.

    A host's tree grows from its root, level by level. At each node

    1. variable segments become one wildcard ``*``: numbers, segments of 32 or more characters,
       and where the node has over ``many`` different segments those with fewer paths than the
       mean (of a node's segments the frequent ones name sections, the rare ones name pages);
    2. branches are compared by their labelled pages: a branch's own where the host has at least
       ``least`` of them there, else those of the same branch over all hosts; with fewer than
       ``least`` of these too it is unknown. Known branches whose share of bad pages does not differ
       from that of the node's other known branches by ``z`` standard errors (a test of two
       proportions, the others together having ``least`` labels too) are alike, and several of
       them are merged into one node ``+``, whose evidence and subtrees are theirs together.
       Unknown and different branches keep their names. A branch's evidence is its own labelled
       pages and ``strength`` pseudo-pages of the same branch's purity over all hosts;
    3. a node's purity is its evidence, smoothed by ``strength`` pseudo-pages of its parent's. The
       root's parent is the purity of the whole table, itself smoothed to one half of no page.

    A node is a row a segment after partial sums, so hot hosts and nodes are spread by segment;
    what belongs to a host, a node or a branch is looked up with hot keys broadcast. Tables of a
    level have no more rows than there are paths, and as many partitions as those need. Without
    labels all purities are 0. Empty paths are the root's. An empty table gives none.
    """
    s = F.lit(float(strength))
    total = leaves.agg(
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("rows")
    ).first()
    everywhere = F.lit(total.bad / (total.n + float(strength)))
    parts = max(1, -(-total.rows // PART_ROWS))

    def kept(frame: DataFrame) -> DataFrame:
        return cut_lineage(frame.coalesce(parts))

    def smooth(bad: Column, n: Column, prior: Column) -> Column:
        return (bad + s * prior) / (n + s)

    segments = F.split(F.regexp_replace("path", "^/", ""), "/", -1)
    rows = leaves.withColumn("segments", F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(segments))
    hosts = kept(leaves.groupBy("host").agg(smooth(F.sum("bad"), F.sum("n"), everywhere).alias("purity")))
    rows = lookup(rows.drop("path").coalesce(parts), hosts, "host", hot_keys(leaves, "host"))
    rows = kept(rows.withColumn("template", F.lit("")))
    for level in range(levels):
        live = rows.withColumn("segment", F.get("segments", F.lit(level)))
        ended = live.where("segment IS NULL").select("key", "host", "n", "bad", "segments", "purity", "template")
        live = live.where("segment IS NOT NULL")
        if live.isEmpty():
            break
        node = F.concat_ws("\x01", "host", "template").alias("node")
        found = kept(
            live.groupBy(node, "template", "segment").agg(
                F.count(F.lit(1)).alias("paths"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.first("purity").alias("above")
            )
        )
        hot = hot_keys(found, "node")
        sizes = found.groupBy("node").agg(F.count(F.lit(1)).alias("kinds"), F.sum("paths").alias("all")).coalesce(parts)
        rare = (F.col("kinds") > many) & (F.col("paths") * F.col("kinds") < F.col("all"))
        variable = F.col("segment").rlike("^[0-9]+$") | (F.length("segment") >= 32) | rare
        told = lookup(found, sizes, "node", hot).withColumn("name", F.when(variable, "*").otherwise(F.col("segment")))
        told = kept(told.withColumn("branch", F.concat_ws("\x01", "node", "name")))
        across = told.groupBy("template", "name").agg(F.sum("bad").alias("xb"), F.sum("n").alias("xn"))
        across = across.select(F.concat_ws("\x01", "template", "name").alias("kind"), "xb", "xn").coalesce(parts)
        seen = told.groupBy("branch", "node", "template", "name").agg(
            F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.first("above").alias("above")
        )
        seen = kept(seen.withColumn("kind", F.concat_ws("\x01", "template", "name")))
        x, enough = smooth(F.col("xb"), F.col("xn"), everywhere), F.col("n") >= least
        known = enough | (F.col("xn") >= least)
        seen = kept(
            lookup(seen, across, "kind", hot_keys(seen, "kind")).select(
                "branch", "node", "name", "above", (F.col("bad") + s * x).alias("e"), (F.col("n") + s).alias("m"),
                F.when(known, F.when(enough, F.col("bad")).otherwise(F.col("xb"))).otherwise(0).alias("tb"),
                F.when(known, F.when(enough, F.col("n")).otherwise(F.col("xn"))).otherwise(0).alias("tn"),
            )
        )
        pooled = seen.groupBy("node").agg(F.sum("tb").alias("sb"), F.sum("tn").alias("sn")).coalesce(parts)
        e, m, tb, tn = F.col("e"), F.col("m"), F.col("tb"), F.col("tn")
        ob, on = F.col("sb") - tb, F.col("sn") - tn
        p = F.col("sb") / F.col("sn")
        error = F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) * (1 / tn + 1 / on))
        # rounded, so that the order of sums does not decide
        near = F.round(F.abs(tb / tn - ob / on), 9) <= F.round(F.lit(float(z)) * error, 9)
        alike = F.when((tn > 0) & (on >= least), near).otherwise(False)
        tested = kept(lookup(seen, pooled, "node", hot).withColumn("alike", alike))
        groups = tested.where("alike").groupBy("node").agg(
            F.count(F.lit(1)).alias("several"), smooth(F.sum("e"), F.sum("m"), F.first("above")).alias("shared")
        )
        # a node without branches alike has a row too
        groups = tested.select("node").distinct().join(groups, "node", "left").coalesce(parts)
        merged = F.col("alike") & (F.coalesce("several", F.lit(0)) > 1)
        final = lookup(tested, groups, "node", hot).select(
            "branch",
            F.when(merged, "+").otherwise(F.col("name")).alias("to"),
            F.when(merged, F.col("shared")).otherwise(smooth(e, m, F.col("above"))).alias("own"),
        )
        known = lookup(told, kept(final), "branch", hot_keys(told, "branch"))
        known = kept(known.select(F.concat_ws("\x01", "node", "segment").alias("at"), "to", "own"))
        live = kept(live.withColumn("at", F.concat_ws("\x01", "host", "template", "segment")))
        moved = lookup(live, known, "at", hot_keys(live, "at")).select(
            "key", "host", "n", "bad", "segments", F.col("own").alias("purity"), F.concat_ws("/", "template", "to").alias("template")
        )
        rows = kept(moved.unionByName(ended))
    more = F.when(F.size("segments") > levels, "/**").otherwise("")
    return rows.select("key", F.concat("template", more).alias("template"), F.round("purity", 6).alias("purity"))


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules=RULES,
    block_above: float = 0.5,
    **tree,
) -> DataFrame:
    """id, host, path, rule, verdict, template and the purity behind it, a row per row of ``pages``.

    The longest fitting rule decides. Pages that a rule judges are the labels of the others: their
    hosts' trees of path templates (see ``path_tree``, which takes the options in ``tree``) give
    each path a purity, the smoothed share of blocked pages, and a page is blocked where that is
    over ``block_above``. Without any label everything is allowed.

    Null and odd urls have an empty host and path, and are judged as such. Repeated rows are
    judged each: different paths are counted once, with the number of their pages. Other columns
    are ignored. An empty table gives no rows.
    """
    host, path = split_url(F.col("url"))
    base = pages.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").alias("url"))
    parsed = base.select("_id", host.alias("host"), path.alias("path"))
    name, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    parsed = parsed.select(
        "_id", "host", "path", name.alias("rule"), verdict.alias("ruled"), F.concat_ws("\x01", "host", "path").alias("key")
    )
    leaves = cut_lineage(
        parsed.groupBy("key", "host", "path").agg(
            F.count("ruled").alias("n"), F.count(F.when(F.col("ruled") == "block", 1)).alias("bad")
        )
    )
    judged = path_tree(leaves, **tree)
    found = lookup(parsed, judged, "key", hot_keys(parsed, "key"))
    own = F.when(F.col("purity") > block_above, F.lit("block")).otherwise(F.lit("allow"))
    return found.select(
        F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "template", "purity"
    )
