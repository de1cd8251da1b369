"""Knowledge graphs: joins, merges, attribute projection, entity resolution, subgraphs and reports.

Nodes have kb_id, id, entity_type, description, source_ids; edges have kb_id, source, target,
relation_type, description, source_ids, weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spindle.functions.ontology import DEFAULT, Ontology
from spindle.functions.text import attribute_value, bigrams, compare_name, consistent_type, entity_name, has_cjk, relation_allowed, relation_of, squeeze
from spindle.functions.udfs import alike_names
from spindle.session import written


def keys_of(c: str) -> Column:
    """All chunk keys of a list whose elements may hold several joined ones, each once in first order."""
    parts = F.flatten(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda s: F.split(F.coalesce(s, F.lit("")), "<SEP>")))
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""))


def union_keys(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The columns by and source_ids: all keys of a group, each once in first order.

    Keys are made distinct before a group comes together, so that a group of many rows holds no more than its keys.
    """
    each = df.select(*by, order, F.posexplode(keys_of("source_ids")).alias("place", "key"))
    first = each.groupBy(*by, "key").agg(F.min(F.struct(order, "place")).alias("at"))
    return first.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", "key")))["key"].alias("source_ids"))


def _with_keys(merged: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    k = keys.select(*[F.col(c).alias(f"_{c}") for c in by], "source_ids")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = merged.join(k, same, "left").drop(*[f"_{c}" for c in by])
    return out.withColumn("source_ids", F.coalesce("source_ids", F.array().cast("array<string>")))


def merge_nodes(nodes: DataFrame, order: str, o: Ontology = DEFAULT) -> DataFrame:
    """One node per kb_id and normalised name: the first type that isn't other, the first description, all keys in order."""
    named = nodes.withColumn("name", entity_name(F.col("id"))).withColumn("kind", consistent_type(F.col("id"), F.col("entity_type"), o))
    at = F.col(order)
    firsts = lambda value, cond: F.min_by(F.when(cond, value), F.when(cond, at))
    merged = named.groupBy("kb_id", "name").agg(
        F.coalesce(firsts(F.col("kind"), F.col("kind") != o.other_type), F.lit(o.other_type)).alias("entity_type"),
        F.coalesce(firsts(squeeze(F.col("description")), squeeze(F.col("description")) != ""), F.lit("")).alias("description"),
        F.count(F.lit(1)).alias("n_merged"),
    )
    return _with_keys(merged, union_keys(named, ["kb_id", "name"], order), ["kb_id", "name"])


def endpoint_types(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with source_type and target_type, empty where the node is unknown. nodes has kb_id, name, entity_type."""
    side = lambda name: nodes.select("kb_id", F.col("name").alias(name), F.col("entity_type").alias(f"{name}_type"))
    out = edges.join(side("source"), ["kb_id", "source"], "left").join(side("target"), ["kb_id", "target"], "left")
    return out.withColumn("source_type", F.coalesce("source_type", F.lit(""))).withColumn("target_type", F.coalesce("target_type", F.lit("")))


def mapped_relations(edges: DataFrame, nodes: DataFrame, o: Ontology = DEFAULT) -> DataFrame:
    """Edges with relation: the one their words name, empty where the types at the ends don't allow it."""
    r = relation_of(F.col("relation_type"), F.col("description"), o)
    e = endpoint_types(edges, nodes).withColumn("r", r)
    return e.withColumn("relation", F.when(relation_allowed(F.col("r"), F.col("source_type"), F.col("target_type"), o), F.col("r")).otherwise("")).drop("r")


def remap(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with both ends renamed by names (kb_id, name, canonical); loops that arise are dropped."""
    side = lambda s: names.select("kb_id", F.col("name").alias(s), F.col("canonical").alias(f"{s}_to"))
    out = edges.join(side("source"), ["kb_id", "source"], "left").join(side("target"), ["kb_id", "target"], "left")
    out = out.withColumn("source", F.coalesce("source_to", "source")).withColumn("target", F.coalesce("target_to", "target"))
    return out.drop("source_to", "target_to").filter(F.col("source") != F.col("target"))


def merge_edges(edges: DataFrame, order: str, relation: str = "relation") -> DataFrame:
    """One edge per kb_id, source, target and relation: the greatest weight, the first description, all keys in order."""
    said = squeeze(F.col("description"))
    by = ["kb_id", "source", "target", relation]
    merged = edges.groupBy(*by).agg(
        F.max("weight").alias("weight"), F.coalesce(F.min_by(F.when(said != "", said), F.when(said != "", F.col(order))), F.lit("N/A")).alias("description"),
        F.count(F.lit(1)).alias("n_merged"),
    )
    return _with_keys(merged, union_keys(edges, by, order), by)


def with_both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    side = lambda s: nodes.select("kb_id", F.col("name").alias(s))
    return edges.join(side("source"), ["kb_id", "source"], "left_semi").join(side("target"), ["kb_id", "target"], "left_semi")


def kept_nodes(nodes: DataFrame, o: Ontology = DEFAULT) -> DataFrame:
    return nodes.filter(F.col("entity_type").isin(*o.core_types, *o.anchor_types, o.multimodal_type))


def project_attributes(nodes: DataFrame, edges: DataFrame, o: Ontology = DEFAULT) -> DataFrame:
    """kb_id, host, field, value: attribute nodes that an edge of either direction ties to a host become values of it."""
    attributes = nodes.filter(F.col("entity_type").isin(*o.attribute_fields)).select("kb_id", F.col("name").alias("attribute"), F.col("entity_type").alias("field"), F.col("description").alias("said"))
    hosts = nodes.filter(F.col("entity_type").isin(*o.attribute_hosts)).select("kb_id", F.col("name").alias("host"))
    ends = lambda a, b: edges.select("kb_id", F.col(a).alias("attribute"), F.col(b).alias("host"), "description")
    both = ends("source", "target").unionByName(ends("target", "source"))
    value = attribute_value(F.col("attribute"), F.col("said"), F.col("description"))
    return both.join(attributes, ["kb_id", "attribute"]).join(hosts, ["kb_id", "host"], "left_semi").select("kb_id", "host", "field", value.alias("value")).distinct()


def incident(edges: DataFrame) -> DataFrame:
    """kb_id, name, other: each edge from both its ends; a loop once."""
    a = edges.select("kb_id", F.col("source").alias("name"), F.col("target").alias("other"), "edge_id")
    b = edges.filter(F.col("source") != F.col("target")).select("kb_id", F.col("target").alias("name"), F.col("source").alias("other"), "edge_id")
    return a.unionByName(b)


def graph_report(nodes: DataFrame, edges: DataFrame, relation: str = "relation") -> DataFrame:
    """kb_id, part, name, n: counts of types and relations, and of nodes whose name isn't in Chinese."""
    part = lambda p, name, df: df.groupBy("kb_id", F.lit(p).alias("part"), name.alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return (
        part("entity_type", F.col("entity_type"), nodes).unionByName(part("relation", F.col(relation), edges))
        .unionByName(part("script", F.when(has_cjk(F.col("name")), "cjk").otherwise("other"), nodes))
    )


GROUP = ["kb_id", "entity_type"]


def _sharing(prefix: DataFrame) -> DataFrame:
    """Pairs a < b of one knowledge base and type that share a gram of their prefixes (GROUP, g, a, k)."""
    left = prefix.select(*GROUP, "g", "a", F.col("k").alias("ka"))
    right = prefix.select(*GROUP, "g", F.col("a").alias("b"), F.col("k").alias("kb"))
    return left.join(right, [*GROUP, "g"]).filter(F.col("a") < F.col("b")).select(*GROUP, "a", "b", "ka", "kb")


def similar_names(nodes: DataFrame, least: float = 0.86) -> DataFrame:
    """kb_id, entity_type, a, b, similarity of different names of one type that are alike.

    Similarity is 1 for names equal but for marks, else the greater of matching blocks and cosine of
    bigram counts. Candidates are exact for both (prefix filtering, rarest grams first). Of two names
    whose blocks reach least, at most u characters of either stay unmatched, so that they share one
    of the u + 1 rarest characters of each. Of two names whose cosine reaches it, the rarest shared
    bigram is followed, in each, by bigrams that make least of its norm.
    """
    n = nodes.select(*GROUP, F.col("name").alias("a")).distinct().withColumn("k", compare_name(F.col("a"))).filter(F.col("k") != "")

    def with_df(grams: DataFrame) -> DataFrame:
        return grams.join(grams.groupBy(*GROUP, "g").agg(F.count(F.lit(1)).alias("df")), [*GROUP, "g"])

    rarest = Window.partitionBy(*GROUP, "a").orderBy("df", "g")
    chars = with_df(n.withColumn("g", F.explode(F.array_distinct(F.split("k", "(?!^)(?=.)")))))
    # blocks that reach least leave the longer name least / (2 - least) times as long as the shorter at the least
    share = least / (2 - least)
    first = chars.withColumn("rank", F.row_number().over(rarest)).filter(F.col("rank") <= F.floor((1 - share) * F.length("k") + 1e-6) + 1)
    near = F.least(F.length("ka"), F.length("kb")) >= F.greatest(F.length("ka"), F.length("kb")) * (share - 1e-9)
    two = with_df(n.withColumn("g", F.explode(bigrams(F.col("k")))).groupBy(*GROUP, "a", "k", "g").agg(F.count(F.lit(1)).alias("c")))
    square = F.sum(F.col("c") * F.col("c"))
    rest, whole = square.over(rarest.rowsBetween(Window.currentRow, Window.unboundedFollowing)), square.over(Window.partitionBy(*GROUP, "a"))
    heavy = two.withColumn("rest", rest).withColumn("whole", whole).filter(F.col("rest") >= F.col("whole") * (least * least - 1e-9))
    pairs = _sharing(first).filter(near).unionByName(_sharing(heavy)).distinct()
    return pairs.withColumn("similarity", alike_names(least)("ka", "kb")).filter(F.col("similarity") >= least).select(*GROUP, "a", "b", "similarity")


def components(pairs: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """node, component (its least node) of the graph of pairs, by alternating large and small stars.

    Each round is written to the shared folder. Labels never leave the executors; a node of many
    neighbours is aggregated, not gathered.
    """
    edges, mark = written(pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).filter(F.col("u") != F.col("v")), "components"), None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") != F.col("v")).distinct()
        least = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(least, "u")
        after = written(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter(F.col("u") != F.col("v")).distinct(), "components"
        )
        edges, before = after, mark
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if mark == before:  # rows are distinct: the same number, sum and mix of hashes is the same rows
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def subgraph(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, most_nodes: int = 180, most_edges: int = 360) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that chunks (chunk_id) support: nodes hit or at the end of an edge hit, capped per kb in the order of their ids."""
    hit = lambda df: df.withColumn("chunk_id", F.explode(keys_of("source_ids"))).join(chunks, "chunk_id", "left_semi")
    e = hit(edges).select("kb_id", "edge_id", "source", "target").distinct()
    ends = e.select("kb_id", F.col("source").alias("name")).unionByName(e.select("kb_id", F.col("target").alias("name")))
    names = hit(nodes).select("kb_id", F.col("id").alias("name")).unionByName(ends).distinct()
    n = nodes.select("kb_id", "node_id", F.col("id").alias("name")).join(names, ["kb_id", "name"], "left_semi")
    rank = lambda key: F.row_number().over(Window.partitionBy("kb_id").orderBy(key))
    n = n.withColumn("r", rank("node_id")).filter(F.col("r") <= most_nodes).drop("r")
    e = e.withColumn("r", rank("edge_id")).filter(F.col("r") <= most_edges).drop("r")
    return n, e


def focused_subgraph(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, whole: bool = False, most_nodes: int = 180, most_edges: int = 360) -> tuple[DataFrame, DataFrame]:
    """kb_id, node_id, highlighted and kb_id, edge_id, highlighted: what a view of a graph shows for chunks (chunk_id).

    Highlighted is what the chunks support. A knowledge base with any of that shows these nodes, the
    ends of these edges, and these edges; one without shows its first nodes and the edges between
    them. Both are capped in the order of ids, unless the whole is asked for.
    """
    hit = lambda df, key: df.withColumn("chunk_id", F.explode(keys_of("source_ids"))).join(chunks.select("chunk_id"), "chunk_id", "left_semi").select(key).distinct().withColumn("highlighted", F.lit(True))
    n = nodes.select("kb_id", "node_id", F.col("id").alias("name")).join(hit(nodes, "node_id"), "node_id", "left").withColumn("highlighted", F.coalesce("highlighted", F.lit(False)))
    e = edges.select("kb_id", "edge_id", "source", "target").join(hit(edges, "edge_id"), "edge_id", "left").withColumn("highlighted", F.coalesce("highlighted", F.lit(False)))
    if whole:
        return n.select("kb_id", "node_id", "highlighted"), e.select("kb_id", "edge_id", "highlighted")
    first = lambda df, key, most: df.withColumn("r", F.row_number().over(Window.partitionBy("kb_id").orderBy(key))).filter(F.col("r") <= most).drop("r")
    lit_n, lit_e = n.filter("highlighted"), e.filter("highlighted")
    names = lit_n.select("kb_id", "name")
    for end in ("source", "target"):
        names = names.unionByName(lit_e.select("kb_id", F.col(end).alias("name")))
    told = lit_n.select("kb_id").unionByName(lit_e.select("kb_id")).distinct()
    focus = first(n.join(names.distinct(), ["kb_id", "name"], "left_semi"), "node_id", most_nodes)
    plain = first(n.join(told, "kb_id", "left_anti"), "node_id", most_nodes)
    between = with_both_ends(e.join(told, "kb_id", "left_anti"), plain)
    out_n, out_e = focus.unionByName(plain.select(*focus.columns)), first(lit_e.unionByName(between.select(*lit_e.columns)), "edge_id", most_edges)
    return out_n.select("kb_id", "node_id", "highlighted"), out_e.select("kb_id", "edge_id", "highlighted")
