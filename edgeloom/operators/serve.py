"""What the graph API serves: node and link projections, search helpers,
visibility filters and indicators. All DataFrame -> DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions.columns import as_date
from edgeloom.functions.constants import SUGGESTIONS
from edgeloom.operators.degree import total_connections
from edgeloom.session import stage, stage_bucketed

ALL_SOURCES = "all"


def by_source(df: DataFrame, source: str | None) -> DataFrame:
    """``all`` or missing: no filter; otherwise equality on the source tag.

    The value is bound as a literal, never formatted into SQL text.
    """
    if source is None or source == ALL_SOURCES:
        return df
    return df.filter(F.col("lineage_source_table") == F.lit(source))


def api_nodes(nodes: DataFrame, links: DataFrame, source: str | None, as_of, mode: str = "reference") -> DataFrame:
    """Nodes as served: renamed, day count since last event, degree (0 if none).

    The degree is computed over all links, whatever the source filter (as the
    reference serves it); the filter applies to the node rows.
    """
    degree = total_connections(links, mode).withColumnRenamed("node", "_deg_node")
    joined = by_source(nodes, source).join(degree, F.col("node") == F.col("_deg_node"), "left")
    return joined.select(
        F.col("node").alias("id"),
        F.col("node").alias("name"),
        F.col("node_type").alias("type"),
        "entity_path",
        F.datediff(as_date(as_of), F.col("last_event_date")).cast("long").alias("days_last_interaction"),
        "last_event_date",
        F.coalesce(F.col("total_connections"), F.lit(0)).cast("long").alias("total_connections"),
        "lineage_source_table",
    )


def api_links(links: DataFrame, source: str | None) -> DataFrame:
    return by_source(links, source).select(
        F.col("source_node").alias("source"),
        F.col("target_node").alias("target"),
        "entity_path",
        F.col("source_node_type").alias("source_type"),
        F.col("target_node_type").alias("target_type"),
        "last_event_date",
        "lineage_source_table",
    )


def node_index(nodes_api: DataFrame) -> DataFrame:
    """``{name, type}`` of every served node (the search box's list)."""
    return nodes_api.select("name", "type")


def suggest(index: DataFrame, text: str, n: int = SUGGESTIONS) -> DataFrame:
    """First ``n`` entries whose name or type contains ``text`` (case-insensitive).

    Blank input gives no rows. Substring test, not LIKE, so ``%``/``_`` are
    literal. Ordered by name, type (the reference leaves the order to its input).
    """
    if text is None or not text.strip():
        return index.filter(F.lit(False))
    t = F.lit(text.lower())
    hit = F.contains(F.lower(F.col("name")), t) | F.contains(F.lower(F.col("type")), t)
    return index.filter(hit).orderBy(F.col("name").asc_nulls_last(), F.col("type").asc_nulls_last()).limit(n)


GRAM = 3


@dataclass
class NameIndex:
    """Search-box entries prepared for many texts: distinct entries with their copies, postings
    ``(gram, name, type, copies)`` of the names' trigrams bucketed by gram, and the first entries of each type."""

    entries: DataFrame
    postings: DataFrame
    firsts: DataFrame
    depth: int


def name_index(index: DataFrame, depth: int = SUGGESTIONS) -> NameIndex:
    """Stage the index. Postings are of names only: a type's trigrams would list all nodes of that type, so of each
    type just its first ``depth`` entries are kept (a top-k per task, no type is gathered)."""
    entries = stage(index.groupBy("name", "type").agg(F.count(F.lit(1)).alias("copies")))
    low = F.lower("name")
    starts = F.when(F.length(low) >= GRAM, F.sequence(F.lit(1), F.length(low) - (GRAM - 1)))
    grams = F.array_distinct(F.transform(starts, lambda i: F.substr(low, i, F.lit(GRAM))))
    postings = stage_bucketed(entries.select(F.explode(grams).alias("gram"), "name", "type", "copies"), ["gram"])
    first = Window.partitionBy("type").orderBy(F.col("name").asc_nulls_last())
    firsts = stage(entries.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= depth).drop("_n"))
    return NameIndex(entries, postings, firsts, depth)


def suggest_from(index: NameIndex, text: str, n: int = SUGGESTIONS) -> DataFrame:
    """:func:`suggest` without reading the nodes: the posting lists of the text's trigrams are intersected (only their
    buckets are read), what is left is verified, and entries of matching types come from the types' first ones.

    Texts under three characters, and more rows than the index keeps per type, scan the entries.
    """
    if text is None or not text.strip():
        return index.entries.select("name", "type").filter(F.lit(False))
    low = text.lower()
    in_name, in_type = (F.contains(F.lower(F.col(c)), F.lit(low)) for c in ("name", "type"))
    if len(low) < GRAM or n > index.depth:
        found = index.entries.filter(in_name | in_type)
    else:
        grams = sorted({low[i:i + GRAM] for i in range(len(low) - GRAM + 1)})
        named = (index.postings.filter(F.col("gram").isin(*grams)).groupBy("name", "type", "copies")
                 .agg(F.count(F.lit(1)).alias("_k")).filter((F.col("_k") == len(grams)) & in_name).drop("_k"))
        found = named.unionByName(index.firsts.filter(in_type)).distinct()
    order = F.col("name").asc_nulls_last(), F.col("type").asc_nulls_last()
    copies = F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(n)).cast("int")))
    return found.orderBy(*order).limit(n).select("name", "type", copies.alias("_c")).orderBy(*order).limit(n).select("name", "type")


def label(name="name", type_="type"):
    return F.concat(F.col(name), F.lit(" ("), F.col(type_), F.lit(")"))


def find_node(index: DataFrame, text_label: str) -> DataFrame:
    """Entries whose ``name (type)`` label equals the chosen suggestion."""
    return index.filter(label() == F.lit(text_label))


def _type_visible(col, hidden_types) -> F.Column:
    hidden = list(hidden_types or [])
    if not hidden:
        return F.lit(True)
    # A NULL type is never among the hidden ones, so it stays visible.
    return F.coalesce(~F.col(col).isin(*hidden), F.lit(True))


def visible_nodes(nodes_api: DataFrame, hidden_types=(), selection: DataFrame | None = None,
                  hide_unselected: bool = False) -> DataFrame:
    """Nodes left on screen: hidden types removed; with ``hide_unselected`` only
    the selection's connected nodes (none while nothing is selected).

    ``selection`` has one column ``node`` (the connected set of the selected node).
    """
    if hide_unselected and selection is None:
        return nodes_api.filter(F.lit(False))
    out = nodes_api.filter(_type_visible("type", hidden_types))
    if hide_unselected:
        out = out.join(selection.select(F.col("node").alias("id")), "id", "left_semi")
    return out


def visible_links(links_api: DataFrame, hidden_types=(), selection: DataFrame | None = None,
                  hide_unselected: bool = False) -> DataFrame:
    """Links whose endpoint types are both visible; with ``hide_unselected``
    both endpoints must be in the selection's connected set."""
    if hide_unselected and selection is None:
        return links_api.filter(F.lit(False))
    out = links_api.filter(_type_visible("source_type", hidden_types) & _type_visible("target_type", hidden_types))
    if hide_unselected:
        sel = selection.select("node")
        out = (out.join(sel.withColumnRenamed("node", "source"), "source", "left_semi")
               .join(sel.withColumnRenamed("node", "target"), "target", "left_semi"))
    return out


def node_types(nodes_api: DataFrame) -> DataFrame:
    """Distinct node types of the graph (the type checkboxes)."""
    return nodes_api.select("type").distinct()


def graph_indicators(nodes_api: DataFrame, links_api: DataFrame) -> DataFrame:
    """Node rows, link rows and the highlighted share before any selection.

    One global aggregate over both inputs (a partial count per task and one
    tiny merge); no join between the two counts.
    """
    n = nodes_api.select(F.lit(1).alias("_n"), F.lit(0).alias("_l"))
    lk = links_api.select(F.lit(0).alias("_n"), F.lit(1).alias("_l"))
    return n.unionByName(lk).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n_nodes"),
        F.coalesce(F.sum("_l"), F.lit(0)).cast("long").alias("n_links"),
        F.lit(0.0).alias("pct_highlighted"),
    )
