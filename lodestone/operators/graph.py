"""A graph of rules, their conditions and conclusions, from rule texts; and walks along it.

Nodes have ids that follow from where they stand, and `ord`, an array that sorts them as a reader meets them, so no
counter over all rows is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

KEY = ["doc_id", "chunk_index"]
#: The patterns that mark conditions, conclusions and references, with (?s) where . takes line feeds too.
CONDITIONS = [
    "(?s)条件[：:]\\s*(.+?)(?=[。\\n]|$)",
    "(?s)如果(.+?)则",
    "(?s)当(.+?)时",
    "(?s)适用条件[：:]\\s*(.+?)(?=[。\\n]|$)",
    "(?s)前提[：:]\\s*(.+?)(?=[。\\n]|$)",
]
CONCLUSIONS = [
    "(?s)则(.+?)(?=[。\\n]|$)",
    "(?s)需要(.+?)(?=[。\\n]|$)",
    "(?s)要求(.+?)(?=[。\\n]|$)",
    "(?s)规定[：:]\\s*(.+?)(?=[。\\n]|$)",
    "(?s)须(.+?)(?=[。\\n]|$)",
]
REFERENCES = ["参见规则([A-Z]\\d+)", "关联规则[：:].+?规则([A-Z]\\d+)", "详见([A-Z]\\d+)"]
SHORTEST_SECTION, SHORTEST_MATCH, TEXT_CHARS = 20, 5, 200


def rule_sections(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, section, text): parts that begin with a rule heading, longer than 20 characters."""
    parts = F.filter(F.transform(F.split("text", "(?=\\*\\*规则[A-Z]\\d+)"), T.strip), lambda s: F.length(s) > SHORTEST_SECTION)
    return chunks.select(*KEY, F.posexplode(parts).alias("section", "text"))


def _section_id() -> Column:
    return F.concat_ws(":", *KEY, "section")


def rule_nodes(sections: DataFrame, chars: int | None = TEXT_CHARS) -> DataFrame:
    """(node_id, type, text, doc_id, chunk_index, rule_id, ord); text is cut to `chars` characters, or whole for None."""
    found = F.nullif(F.regexp_extract("text", "规则([A-Z]\\d+)", 1), F.lit(""))
    place = F.array(*(F.col(c).cast("bigint") for c in (*KEY, "section")), *(F.lit(0).cast("bigint"),) * 3)
    return sections.select(_section_id().alias("node_id"), F.lit("rule").alias("type"), (F.substring("text", 1, chars) if chars is not None else F.col("text")).alias("text"), *KEY, F.coalesce(found, _section_id()).alias("rule_id"), place.alias("ord"))


def _matched(sections: DataFrame, kind: str, number: int, patterns: list[str], relation: str, weight: float) -> tuple[DataFrame, DataFrame]:
    lists = F.array(*(F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in patterns))
    rows = sections.select(*KEY, "section", F.posexplode(lists).alias("pattern", "found")).select(*KEY, "section", "pattern", F.posexplode("found").alias("match", "raw"))
    rows = rows.withColumn("text", T.strip(F.col("raw"))).where(F.length("text") > SHORTEST_MATCH)
    place = F.array(*(F.col(c).cast("bigint") for c in (*KEY, "section")), F.lit(number).cast("bigint"), F.col("pattern").cast("bigint"), F.col("match").cast("bigint"))
    rows = rows.select(F.concat_ws(":", _section_id(), F.lit("con" if number == 1 else "end"), "pattern", "match").alias("node_id"), _section_id().alias("src"), F.substring("text", 1, TEXT_CHARS).alias("text"), *KEY, place.alias("ord"))
    nodes = rows.select("node_id", F.lit(kind).alias("type"), "text", *KEY, F.lit(None).cast("string").alias("rule_id"), "ord")
    return nodes, rows.select("src", F.col("node_id").alias("dst"), F.lit(relation).alias("relation_type"), F.lit(weight).alias("weight"), "ord")


def condition_nodes(sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes, and the edges of their rules to them."""
    return _matched(sections, "condition", 1, CONDITIONS, "requires", 1.0)


def conclusion_nodes(sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _matched(sections, "conclusion", 2, CONCLUSIONS, "leads_to", 0.8)


def reference_edges(rules: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Edges from a rule to the last rule of each id that its text refers to; none where the pair has one.

    Texts are scanned as given: cut in nodes, whole in rule_nodes(sections, None).
    """
    lists = F.array(*(F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in REFERENCES))
    refs = rules.select(F.col("node_id").alias("src"), F.col("ord").alias("from"), F.posexplode(lists).alias("pattern", "found")).select("src", "from", "pattern", F.posexplode("found").alias("match", "rule_id"))
    first = refs.groupBy("src", "rule_id").agg(F.min(F.struct("pattern", "match", "from")).alias("at"))
    target = rules.groupBy("rule_id").agg(F.max_by("node_id", "ord").alias("dst"))
    place = F.concat(F.slice("at.from", 1, 3), F.array(F.lit(3).cast("bigint"), F.col("at.pattern").cast("bigint"), F.col("at.match").cast("bigint")))
    edges = first.join(target, "rule_id").select("src", "dst", F.lit("requires").alias("relation_type"), F.lit(0.9).alias("weight"), place.alias("ord"))
    return edges.join(existing.select("src", "dst"), ["src", "dst"], "left_anti") if existing is not None else edges


def build_graph(chunks: DataFrame, scan_chars: int | None = TEXT_CHARS) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the chunks (doc_id, chunk_index, text).

    References are looked for in the first scan_chars characters of a section, or in all of it for None.
    """
    sections = rule_sections(chunks)
    rules = rule_nodes(sections)
    (a, x), (b, y) = condition_nodes(sections), conclusion_nodes(sections)
    # conditions and conclusions are never rules, so a reference can't repeat one of their edges
    return rules.unionByName(a).unionByName(b), x.unionByName(y).unionByName(reference_edges(rule_nodes(sections, scan_chars)))


#: Out-edges of a node that stay together in a join. A node with more is dealt in parts.
HUB_EDGES = 20_000


def _dealt(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with `part`, hubs): out-edges of a node with more than HUB_EDGES of them are dealt by their target.

    hubs (node, parts) has such nodes only, so at most a row for each HUB_EDGES edges; counts are added up before they are shuffled.
    """
    parts = F.ceil(F.count("*") / HUB_EDGES)
    hubs = edges.groupBy(F.col("src").alias("node")).agg(parts.alias("parts")).where("parts > 1")
    dealt = edges.join(hubs.withColumnRenamed("node", "src"), "src", "left")
    return dealt.withColumn("part", F.coalesce(F.pmod(F.xxhash64("dst"), "parts"), F.lit(0))).drop("parts"), hubs


def _at_parts(frontier: DataFrame, hubs: DataFrame) -> DataFrame:
    """frontier (node, ...) with a row for each part of its node's edges."""
    of_hub = frontier.join(hubs, "node", "left")
    return of_hub.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")


def neighbors(edges: DataFrame, starts: DataFrame, max_hops: int = 2, min_score: float = 0.1) -> DataFrame:
    """(start, node, score, hops): the best product of weights over walks of up to max_hops that never fall below min_score.

    Joins with edges go by node and part, so that a hub's edges are in many tasks.
    """
    best = starts.select(F.col("node_id").alias("start"), F.col("node_id").alias("node"), F.lit(1.0).alias("score"), F.lit(0).alias("hops"))
    frontier = best
    dealt, hubs = _dealt(edges)
    e = dealt.select(F.col("src").alias("node"), "part", "dst", "weight")
    for hop in range(1, max_hops + 1):
        step = _at_parts(frontier.select("start", "node", "score"), hubs).join(e, ["node", "part"]).select("start", F.col("dst").alias("node"), T.fixed(F.col("score") * F.col("weight"), 9).alias("score")).where(F.col("score") >= min_score)
        frontier = step.groupBy("start", "node").agg(F.max("score").alias("score")).withColumn("hops", F.lit(hop))
        best = best.union(frontier)
    top = best.groupBy("start", "node").agg(F.max(F.struct("score", (-F.col("hops")).alias("h"))).alias("b"))
    return top.select("start", "node", "b.score", (-F.col("b.h")).alias("hops"))


def subgraph(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the given ids (node_id) and the edges between them make; unknown ids are ignored."""
    kept = nodes.join(ids.select("node_id"), "node_id", "left_semi")
    at = lambda c: kept.select(F.col("node_id").alias(c))
    return kept, edges.join(at("src"), "src", "left_semi").join(at("dst"), "dst", "left_semi")


def chunk_nodes(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    return nodes.join(chunks.select(*KEY).distinct(), KEY, "left_semi")


def graph_paths(hits: DataFrame, nodes: DataFrame, edges: DataFrame, max_hops: int = 2, decay: float = 0.7, min_path: float = 0.1) -> DataFrame:
    """(query_id, nodes, relations, score, hops, ord, node, improved): every step of a breadth-first walk from the hits' nodes.

    hits has query_id, doc_id, chunk_index, score and rank. `ord` is the order of arrival within a hop; improved tells
    whether the step raised its node's score when it arrived, and only such steps go on. The first hop is always taken.
    """
    start = hits.select("query_id", *KEY, F.coalesce("score", F.lit(0.5)).alias("score"), "rank").join(nodes.select("node_id", *KEY, "ord"), KEY)
    frontier = start.select("query_id", F.col("node_id").alias("node"), "score", F.array("node_id").alias("nodes"), F.array().cast("array<string>").alias("relations"), F.array(F.concat(F.array(F.col("rank").cast("bigint")), "ord")).alias("ord"))
    seen = frontier.groupBy("query_id", "node").agg(F.max("score").alias("before"))
    dealt, hubs = _dealt(edges)
    e = dealt.select(F.col("src").alias("node"), "part", "dst", "relation_type", "weight", F.col("ord").alias("edge_ord"))
    out = None
    for hop in range(1, max(max_hops, 1) + 1):
        step = _at_parts(frontier, hubs).join(e, ["node", "part"]).withColumn("new", T.fixed(F.col("score") * decay * F.col("weight"), 9)).where(F.col("new") >= min_path)
        step = step.select("query_id", F.col("dst").alias("node"), F.col("new").alias("score"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("relations", F.array("relation_type")).alias("relations"), F.concat("ord", F.array("edge_ord")).alias("ord"))
        own = Window.partitionBy("query_id", "node").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
        arrived = step.join(seen, ["query_id", "node"], "left").withColumn("known", F.greatest("before", F.max("score").over(own)))
        arrived = arrived.select("query_id", "nodes", "relations", "score", F.lit(hop).alias("hops"), "ord", "node", (F.col("known").isNull() | (F.col("known") < F.col("score"))).alias("improved"))
        out = arrived if out is None else out.union(arrived)
        frontier = arrived.where("improved").select("query_id", "node", "score", "nodes", "relations", "ord")
        seen = seen.union(frontier.select("query_id", "node", "score")).groupBy("query_id", "node").agg(F.max("before").alias("before"))
    return out


def expanded_chunks(paths: DataFrame, nodes: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, doc_id, chunk_index, score, rank): chunks not among the hits, by the score of their first improving arrival."""
    place = F.struct("hops", "ord")
    arrivals = paths.where("improved").join(nodes.select(F.col("node_id").alias("node"), *KEY), "node")
    first = arrivals.groupBy("query_id", *KEY).agg(F.min_by("score", place).alias("score"), F.min(place).alias("at"))
    new = first.join(hits.select("query_id", *KEY), ["query_id", *KEY], "left_anti")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "at")
    return new.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).drop("at")


def merge_expanded(hits: DataFrame, expanded: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hits (with text) and expanded chunks by score, hits first among equals; an expanded chunk has its first node's text."""
    first = nodes.groupBy(*KEY).agg(F.min_by("text", "ord").alias("text"))
    a = hits.select("query_id", *KEY, "score", "text", F.col("rank").alias("place"), F.lit(False).alias("expanded_via_graph"))
    b = expanded.join(first, KEY).select("query_id", *KEY, "score", "text", F.col("rank").alias("place"), F.lit(True).alias("expanded_via_graph"))
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "expanded_via_graph", "place")
    return a.unionByName(b).withColumn("rank", F.row_number().over(own)).drop("place")


def expand_hits(hits: DataFrame, chunks: DataFrame, top_k: int = 5, max_hops: int = 2, graph: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The first top_k of all: hits (query_id, key, score, rank) and what the chunks' graph leads to from the first top_k.

    The graph (nodes, edges) is that of the same chunks (with text), built here if not given; where it has no edges, the
    first top_k hits come back as they were.
    """
    nodes, edges = graph or build_graph(chunks)
    whole = hits.join(chunks.select(*KEY, "text"), KEY)
    new = expanded_chunks(graph_paths(whole.where(F.col("rank") <= top_k), nodes, edges, max_hops), nodes, whole)
    return merge_expanded(whole, new, nodes).where(F.col("rank") <= top_k)


def graph_stats(chunks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, n): chunks, nodes by type, edges by relation."""
    count = lambda df, name: df.groupBy(name.alias("name")).agg(F.count("*").alias("n"))
    return count(chunks, F.lit("chunks")).union(count(nodes, F.concat(F.lit("node "), F.col("type")))).union(count(edges, F.concat(F.lit("edge "), F.col("relation_type"))))
