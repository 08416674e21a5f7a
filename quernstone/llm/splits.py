"""Problem 1: train, validation and test splits that keep related records together.

Records link the keys they carry (post, course, author).  Connected components of the
keys come from breadth-first search by frontiers: adjacency is hash-partitioned (the lists
of heavy keys over several salts), many seeds expand at once, colliding seed labels form
a much smaller graph that is merged the same way until no collisions remain.  Components
then fall into splits by the order of their hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions.codes import code_key
from quernstone.operators.heavy_keys import find_heavy
from quernstone.session import cut_lineage

HEAVY_SHARE = 0.01
SALTS = 16
#: A collision graph of no more edges is merged in one task.
SMALL_EDGES = 100_000
PARTS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))


def _salted(nodes: DataFrame, column: str, heavy: list) -> DataFrame:
    """One copy of each node for every salt its adjacency list is spread over."""
    salts = F.when(F.col(column).isin(heavy), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))) if heavy else F.array(F.lit(0))
    return nodes.withColumn("salt", F.explode(salts))


def _adjacency(edges: DataFrame) -> tuple[DataFrame, list]:
    """Both directions of distinct (a, b); (src, salt, dst) with heavy sources spread out."""
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct().toDF("src", "dst")
    both = cut_lineage(both)
    heavy = find_heavy(both, F.col("src"), HEAVY_SHARE).keys
    salt = F.when(F.col("src").isin(heavy), F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)) if heavy else F.lit(0)
    return both.withColumn("salt", salt), heavy


def _small_merge(collisions: DataFrame) -> DataFrame:
    """(node, label) of a graph of at most SMALL_EDGES edges, merged in one task."""

    def merge(batches):
        import pandas as pd

        parent: dict[str, str] = {}

        def root(x: str) -> str:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            for a, b in zip(batch["a"], batch["b"]):
                a, b = sorted((root(a), root(b)))
                parent[b] = a
        yield pd.DataFrame([(x, root(x)) for x in list(parent)], columns=["node", "label"])

    return collisions.coalesce(1).mapInPandas(merge, "node string, label string")


def components(edges: DataFrame, nodes: DataFrame | None = None, small_edges: int = SMALL_EDGES) -> DataFrame:
    """(node, label) for edges (a, b) and further single ``nodes`` (node): equal labels are connected.

    Loops and repeated edges change nothing; null ends are ignored; without edges each node
    is its own component. The label is the least node of the component, whatever ``small_edges``.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL").selectExpr("CAST(a AS string) AS a", "CAST(b AS string) AS b")
    adjacency, heavy = _adjacency(edges)
    degree = adjacency.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    rank = F.struct("degree", F.xxhash64("node").alias("h"), F.col("node").alias("n"))
    ranked = degree.select("node", rank.alias("rank"))
    # seeds: nodes that rank above all their neighbours, so hubs expand first
    spread = _salted(ranked, "node", heavy).withColumnRenamed("node", "src")
    above = adjacency.join(spread, ["src", "salt"]).groupBy(F.col("dst").alias("node")).agg(F.max("rank").alias("best"))
    seeds = ranked.join(above, "node").where("rank > best").select("node", F.col("node").alias("label"))
    labels = frontier = cut_lineage(seeds)
    rounds = 0
    while True:
        reached = _salted(frontier, "node", heavy).withColumnRenamed("node", "src").join(adjacency, ["src", "salt"]).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("label"))
        frontier = cut_lineage(reached.join(labels, "node", "left_anti"))
        if frontier.isEmpty():
            break
        # each part is stored already; the union is stored anew only now and then
        rounds += 1
        labels = labels.unionByName(frontier)
        if rounds % 8 == 0:
            labels = cut_lineage(labels)
    # labels that meet at an edge, pre-aggregated by (label, end) before the second join
    met = adjacency.join(_salted(labels, "node", heavy).withColumnRenamed("node", "src"), ["src", "salt"]).select(F.col("dst").alias("node"), F.col("label").alias("a")).distinct()
    met = met.withColumn("salt", F.when(F.col("node").isin(heavy), F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)) if heavy else F.lit(0))
    collisions = cut_lineage(met.join(_salted(labels, "node", heavy).withColumnRenamed("label", "b"), ["node", "salt"]).where("a < b").select("a", "b").distinct())
    n = collisions.count()
    # labels are few beside the nodes: each gets the least node of its component, however its label was merged
    least = labels.groupBy("label").agg(F.min("node").alias("least"))
    if n:
        merged = _small_merge(collisions) if n <= small_edges else components(collisions, None, small_edges)
        merged = cut_lineage(merged.select(F.col("node").alias("label"), F.col("label").alias("root")))
        roots = cut_lineage(least.join(merged, "label", "left").select("label", F.coalesce("root", "label").alias("root"), "least"))
        least = roots.join(roots.groupBy("root").agg(F.min("least").alias("first")), "root").select("label", F.col("first").alias("least"))
    # both sides are stored, so a hub's label is split at run time
    labels = cut_lineage(labels).join(cut_lineage(least), "label").select("node", F.col("least").alias("label"))
    if nodes is not None:
        alone = nodes.where("node IS NOT NULL").select(F.col("node").cast("string").alias("node")).distinct().join(labels, "node", "left_anti")
        labels = labels.unionByName(alone.select("node", F.col("node").alias("label")))
    return cut_lineage(labels)


def record_keys(records: DataFrame, posts: DataFrame) -> DataFrame:
    """The keys of each labelled record: post, course and the post's author.

    Adds post_key, course_key and user_keys (an array: captures of a post may differ). Blank
    ids and codes, null and [deleted] authors are no keys.
    """
    post = F.trim("post_id")
    keyed = records.withColumn("post_key", F.when(post != "", post)).withColumn("course_key", code_key(F.col("course_code")))
    known = keyed.select(F.col("post_key").alias("__p")).where("__p IS NOT NULL").distinct()
    authors = (
        posts.select(F.col("post_id").alias("__p"), F.col("username").alias("__u"))
        .where("__u IS NOT NULL AND __u <> '[deleted]'")
        .join(known, "__p", "left_semi")
        .groupBy("__p")
        .agg(F.sort_array(F.collect_set("__u")).alias("user_keys"))
    )
    none = F.array().cast("array<string>")
    found = keyed.where("post_key IS NOT NULL").join(authors, F.col("post_key") == F.col("__p"), "left").drop("__p").withColumn("user_keys", F.coalesce("user_keys", none))
    return found.unionByName(keyed.where("post_key IS NULL").withColumn("user_keys", none))  # null keys would meet in one task


def _node(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), value)


def key_components(keyed: DataFrame) -> DataFrame:
    """(node, label) of all keys of records as record_keys gives them."""
    course = _node("course_code", F.col("course_key"))
    links = F.concat(F.array(course), F.transform("user_keys", lambda u: _node("username", u)))
    pairs = keyed.select(_first_node().alias("a"), F.explode(F.filter(links, lambda x: x.isNotNull())).alias("b")).distinct()
    return components(pairs, keyed.select(_first_node().alias("node")))


def _first_node() -> Column:
    """The post of a record, else its course; null where it has neither."""
    return F.coalesce(_node("post_id", F.col("post_key")), _node("course_code", F.col("course_key")))


def _with_component(keyed: DataFrame) -> DataFrame:
    """Adds component: the least key of the record's component, null for records without keys."""
    labels = key_components(keyed).select(F.col("node").alias("__node"), F.col("label").alias("component"))
    named = keyed.withColumn("__node", _first_node())
    found = named.where("__node IS NOT NULL").join(labels, "__node").drop("__node")
    return found.unionByName(named.where("__node IS NULL").drop("__node").withColumn("component", F.lit(None).cast("string")))


def linked_splits(records: DataFrame, posts: DataFrame, parts: tuple = PARTS) -> DataFrame:
    """Every record with its component and its new split (columns component, new_split).

    Components in hash order take the split their middle falls in, so shares are met as
    closely as whole components allow; a component that holds most records takes one split.
    Records without any key are components of their own; repeated records stay repeated.
    Existing columns named as the two new ones are replaced.
    """
    records = records.drop("component", "new_split")
    keyed = cut_lineage(record_keys(records, posts))
    own = F.concat(F.lit("record:"), F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in records.columns])))
    every = _with_component(keyed).withColumn("component", F.coalesce("component", own))
    h = F.conv(F.substring(F.md5("component"), 1, 15), 16, 10).cast("bigint")
    sizes = every.groupBy("component").agg(F.count(F.lit(1)).alias("size")).withColumn("h", h)
    # running totals: by 4096 ranges of the hash first, then within a range
    sizes = sizes.withColumn("range", F.shiftright("h", 48))
    ranges = sizes.groupBy("range").agg(F.sum("size").alias("held"))
    before = ranges.withColumn("before", F.sum("held").over(Window.orderBy("range")) - F.col("held")).withColumn("total", F.sum("held").over(Window.partitionBy()))
    placed = sizes.join(F.broadcast(before), "range")
    middle = (F.col("before") + F.sum("size").over(Window.partitionBy("range").orderBy("h", "component")) - F.col("size") / 2) / F.col("total")
    new, edge = F.lit(parts[-1][0]), 1.0
    for i in range(len(parts) - 2, -1, -1):
        edge -= parts[i + 1][1]
        new = F.when(F.col("__m") < edge, parts[i][0]).otherwise(new)
    assigned = cut_lineage(placed.withColumn("__m", middle).select("component", new.alias("new_split"), (F.col("size") >= F.col("total") * F.lit(HEAVY_SHARE)).alias("heavy")))
    # heavy components, at most 1 / HEAVY_SHARE, are broadcast; the others are joined by a shuffle
    hot = F.broadcast(assigned.where("heavy").select("component", "new_split"))
    every = every.drop("post_key", "course_key", "user_keys")
    rest = every.join(hot.select("component"), "component", "left_anti").join(assigned.where("NOT heavy").select("component", "new_split"), "component")
    return every.join(hot, "component").unionByName(rest)


def leaking_keys(records: DataFrame, posts: DataFrame) -> DataFrame:
    """(key_kind, key_value): keys whose records stand in more than one declared split.

    Only components whose records hold several splits can have such a key, so the others' records
    are set aside; of the rest each key's records are checked. Splits compare trimmed and
    upper-cased, blank ones are ignored.
    """
    split = F.upper(F.trim("split"))
    placed = cut_lineage(_with_component(cut_lineage(record_keys(records, posts))).where("component IS NOT NULL").withColumn("split", split).where("split <> ''"))
    mixed = cut_lineage(placed.groupBy("component").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo <> hi").select("component"))
    kinds = F.concat(
        F.array(F.struct(F.lit("post_id").alias("kind"), F.col("post_key").alias("value")), F.struct(F.lit("course_code").alias("kind"), F.col("course_key").alias("value"))),
        F.transform("user_keys", lambda u: F.struct(F.lit("username").alias("kind"), u.alias("value"))),
    )
    return (
        placed.join(mixed, "component", "left_semi")
        .select("split", F.explode(kinds).alias("key"))
        .where("key.value IS NOT NULL")
        .groupBy(F.col("key.kind").alias("key_kind"), F.col("key.value").alias("key_value"))
        .agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
        .where("lo <> hi")
        .select("key_kind", "key_value")
    )
