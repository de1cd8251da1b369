"""Cleanup of a whole knowledge graph: normalised names, merged slots, facts, projection, resolution and rewriting.

A graph is three tables. nodes: kb_id, name, entity_type, modality, description, source_ids,
file_paths (lists without repetition, in first order), created_at, n_merged. edges: kb_id, source,
target, relation, description, keywords, source_ids, file_paths, weight, created_at, n_merged.
facts: kb_id, name, field, value and where each was read (chunk, file, page); names by which a node
is also known are facts of the field of aliases. Lists are made distinct by value before a group
comes together, so that a name of many records holds no more than its different values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from spindle.functions.ontology import DEFAULT, Ontology
from spindle.functions.predicates import empty_description
from spindle.functions.text import attribute_field, attribute_value, consistent_type, entity_name, has_cjk, is_alias, modality_of, relation_allowed, relation_of, squeeze, stage_parts
from spindle.operators.graph import components, kept_nodes, keys_of, similar_names, with_both_ends
from spindle.session import written

LISTS = ("description", "keywords", "source_ids", "file_paths")
#: Columns that are read of nodes and edges; others are left alone.
NODE = ["node_id", "kb_id", "id", "entity_type", "description", "source_ids", "file_path", "attributes", "created_at"]
EDGE = ["edge_id", "kb_id", "source", "target", "relation_type", "description", "source_ids", "file_path", "weight", "created_at"]
FACT = ["kb_id", "name", "field", "value", "chunk", "file", "page"]


def joined(c: str) -> Column:
    return F.array_join(F.col(c), "<SEP>")


def pieces(c: Column) -> Column:
    """A text as the list of its joined pieces, trimmed, none blank."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "<SEP>"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def union_lists(df: DataFrame, by: list[str], order: str, lists: tuple[str, ...]) -> DataFrame:
    """The columns by and each of lists: the different values of a group in first order, in two exchanges for all lists."""
    entry = lambda name: lambda x, i: F.struct(F.lit(name).alias("list"), i.alias("place"), x.alias("value"))
    each = df.select(*by, order, F.explode(F.concat(*[F.transform(F.col(c), entry(c)) for c in lists])).alias("e")).select(*by, order, "e.*")
    first = each.groupBy(*by, "list", "value").agg(F.min(F.struct(order, "place")).alias("at"))
    got = first.groupBy(*by).agg(*[F.array_sort(F.collect_list(F.when(F.col("list") == c, F.struct("at", "value"))))["value"].alias(c) for c in lists])
    return got


def with_lists(merged: DataFrame, df: DataFrame, by: list[str], order: str, lists: tuple[str, ...]) -> DataFrame:
    """merged with the united lists of df; null keys are equal, groups without values have empty lists."""
    right = union_lists(df, by, order, lists)
    right = right.select(*[F.col(c).alias(f"_{c}") for c in by], *lists)
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = merged.join(right, same, "left").drop(*[f"_{c}" for c in by])
    return out.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in lists})


def normalized_entity(name: Column, kind: Column, o: Ontology = DEFAULT) -> Column:
    """name, entity_type, modality and aliases of a node as typed: a pest's name loses its stage of life, which stays as an alias."""
    k, full = consistent_type(name, kind, o), entity_name(name)
    p = stage_parts(full, o)
    staged = (k == o.staged_type) & (p["stage"] != "") & (p["base"] != "") & (p["base"] != full)
    short = F.when(staged, p["base"]).otherwise(full)
    others = F.filter(F.array(F.when(staged, full), full), lambda a: a.isNotNull() & (a != "") & (a != short) & (a != o.nameless))
    return F.struct(short.alias("name"), k.alias("entity_type"), modality_of(name, kind, o).alias("modality"), F.array_distinct(others).alias("aliases"))


def normalized_nodes(nodes: DataFrame, o: Ontology = DEFAULT) -> DataFrame:
    """Nodes with typed (the name as given) and the parts of normalized_entity; null names are left out."""
    return (
        nodes.select(*NODE).filter(F.col("id").isNotNull()).withColumn("e", normalized_entity(F.col("id"), F.col("entity_type"), o)).withColumn("typed", squeeze(F.col("id")))
        .drop("entity_type").select("*", "e.name", "e.entity_type", "e.modality", "e.aliases").drop("e")
    )


def merged_slots(named: DataFrame, order: str, o: Ontology = DEFAULT) -> DataFrame:
    """One node a name: the first type that isn't other, the first modality, the latest time, all lists united."""
    at = F.col(order)
    first = lambda value, cond: F.min_by(F.when(cond, value), F.when(cond, at))
    merged = named.groupBy("kb_id", "name").agg(
        F.coalesce(first(F.col("entity_type"), F.col("entity_type") != o.other_type), F.lit(o.other_type)).alias("entity_type"),
        F.coalesce(first(F.col("modality"), F.col("modality") != ""), F.lit("")).alias("modality"),
        F.max("created_at").alias("created_at"), F.count(F.lit(1)).alias("n_merged"),
    )
    lists = named.select("kb_id", "name", order, pieces(squeeze(F.col("description"))).alias("description"), keys_of("source_ids").alias("source_ids"), pieces(F.col("file_path")).alias("file_paths"))
    return with_lists(merged, lists, ["kb_id", "name"], order, ("description", "source_ids", "file_paths"))


def _fact(df: DataFrame, field, value: Column, chunk: Column | None = None, file: Column | None = None) -> DataFrame:
    blank = F.lit("")
    return df.select("kb_id", "name", field.alias("field"), value.alias("value"), (chunk if chunk is not None else blank).alias("chunk"), (file if file is not None else blank).alias("file"), blank.alias("page"))


def own_facts(named: DataFrame, o: Ontology = DEFAULT) -> DataFrame:
    """Facts that records bring: their attributes, and the names they had."""
    names = named.select("kb_id", "name", F.explode(F.array_distinct(F.concat("aliases", F.array("typed")))).alias("a")).filter((F.col("a") != "") & (F.col("a") != F.col("name")))
    told = named.select("kb_id", "name", F.explode(F.coalesce("attributes", F.create_map().cast("map<string,string>"))).alias("k", "v")).filter(F.coalesce(F.trim("v"), F.lit("")) != "")
    return _fact(names, F.lit(o.alias_field), F.col("a")).unionByName(_fact(told, F.col("k"), F.trim("v")))


def renamed(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges whose ends take the name of the node that they are the given name of; unknown ones stay."""
    side = lambda s: names.select("kb_id", F.col("given").alias(s), F.col("name").alias(f"{s}_name"))
    out = edges.select(*EDGE).join(side("source"), ["kb_id", "source"], "left").join(side("target"), ["kb_id", "target"], "left")
    return out.withColumn("source", F.coalesce("source_name", "source")).withColumn("target", F.coalesce("target_name", "target")).drop("source_name", "target_name")


def normalized_edges(edges: DataFrame, nodes: DataFrame, o: Ontology = DEFAULT) -> DataFrame:
    """Edges with alias (it says that both ends are the same), relation (empty where not allowed) and keywords as given; blank descriptions become N/A."""
    kinds = lambda s: nodes.select("kb_id", F.col("name").alias(s), F.col("entity_type").alias(f"{s}_type"))
    e = edges.join(kinds("source"), ["kb_id", "source"], "left").join(kinds("target"), ["kb_id", "target"], "left")
    said, words = squeeze(F.col("description")), squeeze(F.col("relation_type"))
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    e = e.withColumn("alias", is_alias(words, said, o)).withColumn("r", relation_of(words, said, o))
    r = F.when(~F.col("alias") & relation_allowed(F.col("r"), some("source_type"), some("target_type"), o), F.col("r")).otherwise("")
    return e.withColumn("relation", r).withColumn("keywords", words).withColumn("description", F.when(said == "", "N/A").otherwise(said)).drop("r")


def merged_relations(edges: DataFrame, order: str) -> DataFrame:
    """One edge a source, target and relation: all descriptions, keywords, keys and files, the greatest weight, the latest time."""
    by = ["kb_id", "source", "target", "relation"]
    merged = edges.groupBy(*by).agg(F.max("weight").alias("weight"), F.max("created_at").alias("created_at"), F.count(F.lit(1)).alias("n_merged"))
    lists = edges.select(*by, order, pieces(F.col("description")).alias("description"), pieces(F.col("keywords")).alias("keywords"), keys_of("source_ids").alias("source_ids"), pieces(F.col("file_path")).alias("file_paths"))
    return with_lists(merged, lists, by, order, LISTS)


def alias_facts(edges: DataFrame, nodes: DataFrame, o: Ontology = DEFAULT) -> DataFrame:
    """Each end of an alias edge is a name of the other, where that is a node."""
    a = edges.filter(F.col("alias") & (F.col("source") != F.col("target")))
    both = a.select("kb_id", F.col("source").alias("name"), F.col("target").alias("a")).unionByName(a.select("kb_id", F.col("target").alias("name"), F.col("source").alias("a")))
    return _fact(both.filter(F.col("a") != "").join(nodes.select("kb_id", "name"), ["kb_id", "name"], "left_semi"), F.lit(o.alias_field), F.col("a"))


def projected_facts(nodes: DataFrame, edges: DataFrame, o: Ontology = DEFAULT) -> DataFrame:
    """Attribute nodes that an edge ties to a host become facts of it, with the chunks and files of the edge."""
    attributes = nodes.filter(F.col("entity_type").isin(*o.attribute_fields)).select("kb_id", F.col("name").alias("attribute"), F.col("entity_type").alias("field"), joined("description").alias("said"))
    hosts = nodes.filter(F.col("entity_type").isin(*o.attribute_hosts)).select("kb_id", "name")
    ends = lambda a, b: edges.select("kb_id", F.col(a).alias("attribute"), F.col(b).alias("name"), joined("description").alias("edge_said"), joined("source_ids").alias("chunk"), joined("file_paths").alias("file"))
    both = ends("source", "target").unionByName(ends("target", "source"))
    found = both.join(attributes, ["kb_id", "attribute"]).join(hosts, ["kb_id", "name"], "left_semi")
    return _fact(found, F.col("field"), attribute_value(F.col("attribute"), F.col("said"), F.col("edge_said")), F.col("chunk"), F.col("file"))


def edge_facts(nodes: DataFrame, edges: DataFrame, o: Ontology = DEFAULT) -> DataFrame:
    """What the words of an edge say of its source, where that is a host: the field that they name, the description as value."""
    hosts = nodes.filter(F.col("entity_type").isin(*o.attribute_hosts)).select("kb_id", "name")
    e = edges.withColumn("name", F.col("source")).withColumn("field", attribute_field(F.col("relation"), F.col("keywords"), F.col("description"), o))
    value = squeeze(F.col("description"))
    return _fact(e.filter((F.col("field") != "") & (value != "")).join(hosts, ["kb_id", "name"], "left_semi"), F.col("field"), value, F.array_join(keys_of("source_ids"), "<SEP>"), F.coalesce("file_path", F.lit("")))


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    facts: DataFrame


def fact_lists(facts: DataFrame) -> DataFrame:
    """kb_id, name, field and the different values, sorted."""
    return facts.select("kb_id", "name", "field", "value").distinct().groupBy("kb_id", "name", "field").agg(F.sort_array(F.collect_list("value")).alias("values"))


def slots(nodes: DataFrame, edges: DataFrame, o: Ontology = DEFAULT, name: str = "cleanup") -> Graph:
    """The graph as parsed, normalised and merged: every node, every edge that has a relation and two nodes, all facts.

    nodes has node_id, kb_id, id, entity_type, description, source_ids, file_path, attributes,
    created_at; edges has edge_id, kb_id, source, target, relation_type, description, source_ids,
    file_path, weight, created_at. Empty tables give empty ones; a null kb_id is a knowledge base of
    its own whose edges meet no node; nodes without a name are left out.
    """
    named = written(normalized_nodes(nodes, o), f"{name}-named")
    merged = written(merged_slots(named, "node_id", o), f"{name}-nodes")
    # of two nodes with one given name the later decides what edges mean by it
    given = named.groupBy("kb_id", F.col("id").alias("given")).agg(F.max_by("name", "node_id").alias("name"))
    e = written(normalized_edges(renamed(edges, given), merged.select("kb_id", "name", "entity_type"), o), f"{name}-edges")
    related = merged_relations(with_both_ends(e.filter(F.col("relation") != ""), merged), "edge_id")
    facts = own_facts(named, o).unionByName(alias_facts(e, merged, o))
    return Graph(merged, written(related, f"{name}-relations"), facts)


def projected(g: Graph, o: Ontology = DEFAULT) -> Graph:
    """Attribute nodes as facts of their hosts, and only nodes of kept types that say something."""
    facts = g.facts.unionByName(projected_facts(g.nodes, g.edges, o))
    empty = (F.col("entity_type") == o.multimodal_type) & empty_description(joined("description"), F.lit(""))
    nodes = kept_nodes(g.nodes, o).filter(~empty)
    return Graph(nodes, with_both_ends(g.edges, nodes), facts.join(nodes.select("kb_id", "name"), ["kb_id", "name"], "left_semi"))


def strict_threshold(t: float) -> float:
    return round(min(0.99, max(t + 0.08, 0.92)), 6)


def gray_threshold(t: float) -> float:
    return max(0.0, min(t, strict_threshold(t) - 0.02))


def chosen_names(g: Graph, groups: DataFrame, o: Ontology = DEFAULT) -> DataFrame:
    """kb_id, name, canonical: the member of each group (kb_id, group, name) that is in Chinese, then has most fields and aliases, says most, is shortest."""
    counts = g.facts.select("kb_id", "name", "field", "value").distinct().groupBy("kb_id", "name").agg(
        (F.count_if(F.col("field") == o.alias_field) + F.count_distinct("field")).alias("told")
    )
    known = g.nodes.select("kb_id", "name", F.least(F.length(joined("description")), F.lit(300)).alias("said")).join(counts, ["kb_id", "name"], "left")
    score = F.struct(has_cjk(F.col("name")).cast("int").alias("cjk"), F.coalesce("told", F.lit(0)).alias("told"), F.coalesce("said", F.lit(0)).alias("said"), (-F.length("name")).alias("short"), F.col("name").alias("n"))
    scored = groups.join(known, ["kb_id", "name"], "left").withColumn("score", score)
    best = scored.groupBy("kb_id", "group").agg(F.max_by("name", "score").alias("canonical"))
    return groups.join(best, ["kb_id", "group"]).select("kb_id", "name", "canonical")


def alike_groups(pairs: DataFrame, most_members: int) -> DataFrame:
    """kb_id, group, name of pairs (kb_id, entity_type, a, b): connected names, in groups of two to most_members; greater groups are no groups."""
    key = lambda c: F.concat_ws("\u0001", "kb_id", "entity_type", c)
    found = components(pairs.select(key("a").alias("a"), key("b").alias("b")))
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members").between(2, most_members))
    p = F.split("node", "\u0001")
    return found.join(sizes, "component").select(p[0].alias("kb_id"), F.col("component").alias("group"), p[2].alias("name"))


def canonical_remap(g: Graph, names: DataFrame, o: Ontology = DEFAULT) -> tuple[Graph, DataFrame]:
    """The graph with nodes renamed by names (kb_id, name, canonical), and kb_id, node_pairs, edge_pairs: how many were absorbed.

    Nodes that meet are merged, their former names become aliases; edges that meet are merged, loops vanish uncounted.
    """
    to = names.filter(F.col("name") != F.col("canonical"))
    n = g.nodes.join(to, ["kb_id", "name"], "left").withColumn("was", F.col("name")).withColumn("name", F.coalesce("canonical", "name")).drop("canonical")
    first = F.struct((F.col("was") != F.col("name")).cast("int"), F.col("was"))
    n = n.withColumn("at", first)
    nodes = n.groupBy("kb_id", "name").agg(
        F.min_by("entity_type", "at").alias("entity_type"), F.min_by("modality", "at").alias("modality"), F.max("created_at").alias("created_at"), F.sum("n_merged").alias("n_merged"),
        F.count(F.lit(1)).alias("here"),
    )
    nodes = with_lists(nodes, n, ["kb_id", "name"], "at", ("description", "source_ids", "file_paths"))
    side = lambda s: to.select("kb_id", F.col("name").alias(s), F.col("canonical").alias(f"{s}_to"))
    e = g.edges.join(side("source"), ["kb_id", "source"], "left").join(side("target"), ["kb_id", "target"], "left")
    e = e.withColumn("at", F.struct("source", "target")).withColumn("source", F.coalesce("source_to", "source")).withColumn("target", F.coalesce("target_to", "target")).drop("source_to", "target_to")
    e, by = e.filter(F.col("source") != F.col("target")), ["kb_id", "source", "target", "relation"]
    edges = e.groupBy(*by).agg(F.max("weight").alias("weight"), F.max("created_at").alias("created_at"), F.sum("n_merged").alias("n_merged"), F.count(F.lit(1)).alias("here"))
    edges = with_lists(edges, e, by, "at", LISTS)
    counts = (
        nodes.groupBy("kb_id").agg(F.sum(F.col("here") - 1).alias("node_pairs"), F.lit(0).cast("long").alias("edge_pairs"))
        .unionByName(edges.groupBy("kb_id").agg(F.lit(0).cast("long").alias("node_pairs"), F.sum(F.col("here") - 1).alias("edge_pairs")))
        .groupBy("kb_id").agg(F.sum("node_pairs").alias("node_pairs"), F.sum("edge_pairs").alias("edge_pairs"))
    )
    moved = g.facts.join(to, ["kb_id", "name"], "left").withColumn("name", F.coalesce("canonical", "name")).select(*FACT)
    facts = moved.filter((F.col("field") != o.alias_field) | (F.col("value") != F.col("name"))).unionByName(_fact(to.select("kb_id", F.col("canonical").alias("name"), F.col("name").alias("a")), F.lit(o.alias_field), F.col("a")))
    return Graph(nodes.drop("here"), edges.drop("here"), facts), counts


def vector_strict(g: Graph, threshold: float = 0.86, most_members: int = 12, o: Ontology = DEFAULT) -> DataFrame:
    """kb_id, name, canonical of nodes of mergeable types whose names are alike beyond doubt."""
    eligible = g.nodes.filter(F.col("entity_type").isin(*o.mergeable_types))
    return chosen_names(g, alike_groups(similar_names(eligible, strict_threshold(threshold)), most_members), o)


def gray_groups(g: Graph, threshold: float = 0.86, most_members: int = 12, o: Ontology = DEFAULT) -> DataFrame:
    """kb_id, entity_type, group, members: names alike, but not beyond doubt, for someone to decide.

    members gives each name with at most eight aliases, the head of its description and its fields.
    """
    eligible = g.nodes.filter(F.col("entity_type").isin(*o.mergeable_types))
    pairs = similar_names(eligible, gray_threshold(threshold)).filter(F.col("similarity") < strict_threshold(threshold))
    groups = alike_groups(pairs, most_members)
    told = g.facts.select("kb_id", "name", "field", "value").distinct().groupBy("kb_id", "name").agg(
        F.slice(F.sort_array(F.collect_set(F.when(F.col("field") == o.alias_field, F.col("value")))), 1, 8).alias("aliases"), F.sort_array(F.collect_set("field")).alias("fields")
    )
    n = groups.join(g.nodes.select("kb_id", "name", "entity_type", F.substring(joined("description"), 1, 280).alias("description")), ["kb_id", "name"]).join(told, ["kb_id", "name"], "left")
    none = F.array().cast("array<string>")
    member = F.struct("name", F.coalesce("aliases", none).alias("aliases"), "description", F.coalesce("fields", none).alias("fields"))
    return n.groupBy("kb_id", "entity_type", "group").agg(F.array_sort(F.collect_list(member)).alias("members"))


ANSWER = "kb_id string, name string, canonical string"


def arbitrated(groups: DataFrame, arbiter: Callable[[str, list[dict]], str], least_confidence: float = 0.9) -> DataFrame:
    """kb_id, name, canonical by the answers of arbiter, a function of an entity type and members that runs in the tasks.

    An answer is JSON: groups of canonical, members and confidence. A group counts if its canonical
    is among its members, at least two of which were asked about, and its confidence suffices. Of
    groups that name a member twice the first counts; answers that can't be read count for nothing.
    """
    from spindle.functions.udfs import canonical_groups

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for kb, kind, members in zip(frame["kb_id"], frame["entity_type"], frame["members"]):
                asked = [{k: list(v) if k in ("aliases", "fields") else v for k, v in m.items()} for m in members]
                taken: set[str] = set()
                for canonical, names, _ in canonical_groups(arbiter(kind, asked), {m["name"] for m in asked}, least_confidence):
                    if not taken & set(names):
                        taken |= set(names)
                        out += [(kb, n, canonical) for n in names]
            yield pd.DataFrame(out, columns=["kb_id", "name", "canonical"])

    return groups.select("kb_id", "entity_type", "members").mapInPandas(run, ANSWER)


def clean_graph(nodes: DataFrame, edges: DataFrame, threshold: float = 0.86, arbiter: Callable[[str, list[dict]], str] | None = None, o: Ontology = DEFAULT, name: str = "cleanup") -> tuple[Graph, DataFrame]:
    """The whole cleanup, and kb_id, node_pairs, edge_pairs of what was merged; arbiter decides doubtful names if given."""
    g = projected(slots(nodes, edges, o, name), o)
    g = Graph(written(g.nodes, f"{name}-kept"), written(g.edges, f"{name}-kept-edges"), written(g.facts, f"{name}-facts"))
    g, counts = canonical_remap(g, written(vector_strict(g, threshold, o=o), f"{name}-strict"), o)
    if arbiter is not None:
        g = Graph(written(g.nodes, f"{name}-again"), written(g.edges, f"{name}-again-edges"), written(g.facts, f"{name}-again-facts"))
        g, more = canonical_remap(g, written(arbitrated(gray_groups(g, threshold, o=o), arbiter), f"{name}-gray"), o)
        counts = counts.unionByName(more).groupBy("kb_id").agg(F.sum("node_pairs").alias("node_pairs"), F.sum("edge_pairs").alias("edge_pairs"))
    return g, counts


def preprocessed(records: DataFrame, edges: DataFrame, o: Ontology = DEFAULT, typed: bool = True, by: str = "chunk_id", name: str = "extracted") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and facts of extraction results, chunk by chunk, before they enter a graph.

    records and edges have the columns of slots, kb_id aside, and by, the chunk they were read from.
    typed keeps only nodes of kept types and takes facts from attribute nodes and edge texts; without
    it (the plainer mode) all types stay, and edges need no more than a relation.
    """
    g = lambda df: df.withColumn("kb_id", F.col(by))
    named = normalized_nodes(g(records), o)
    empty = (F.col("entity_type") == o.multimodal_type) & empty_description(F.coalesce("description", F.lit("")), F.lit(""))
    named = written(named.filter(~empty), f"{name}-named")
    merged = written(merged_slots(named, "node_id", o), f"{name}-nodes")
    given = named.groupBy("kb_id", F.col("id").alias("given")).agg(F.max_by("name", "node_id").alias("name"))
    e = written(normalized_edges(renamed(g(edges), given), merged.select("kb_id", "name", "entity_type"), o), f"{name}-edges")
    related = e.filter(F.col("relation") != "")
    facts = own_facts(named, o).unionByName(alias_facts(e, merged, o))
    if typed:
        keep = kept_nodes(merged, o)
        # any edge may tie an attribute to a host, also one without a relation
        tied = e.filter(~F.col("alias")).withColumn("description", F.array("description")).withColumn("source_ids", keys_of("source_ids")).withColumn("file_paths", pieces(F.col("file_path")))
        related = with_both_ends(related.filter(F.col("relation").isin(*o.relations)), keep)
        facts = facts.unionByName(projected_facts(merged, tied, o)).unionByName(edge_facts(keep, related, o))
        merged, facts = keep, facts.join(keep.select("kb_id", "name"), ["kb_id", "name"], "left_semi")
    out = related.select(F.col("kb_id").alias(by), "edge_id", "source", "target", "relation", "keywords", "description")
    return merged.withColumnRenamed("kb_id", by), out, facts.withColumnRenamed("kb_id", by)
