"""Registered queries: audit scan, deletion purge, orphans, validation,
upserts and retention."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from edgeloom import oracle as O
from edgeloom.operators import purge as P
from edgeloom.operators import upsert as U
from edgeloom.plans.build import GraphBuild
from edgeloom.plans.registry import register
from edgeloom.sources import scans as S
from edgeloom.sources.fixtures import PURGE_DAYS, UPSERT_SPLIT

W = O.with_ctes
T = "'TABLE/VIEW/PATH'"


def audit_flat(c):
    return S.audit_scan(c.fx.audit())


def dels(c):
    return c.once("deletions", lambda: P.deletions(audit_flat(c), c.host, c.as_of, c.days))


def ids(c):
    return c.once("valid_ids", lambda: S.valid_table_ids(c.fx.inventory(), c.fx.legacy()))


def hits(c):
    """Hits with the number of deletions behind each: as many rows as there are nodes hit, however often a schema goes."""
    return c.once("deleted", lambda: P.deleted_entities(c.g.nodes(), dels(c), counted=True))


def links_merged(c):
    return c.once("links_after_merge", lambda: P.match_deleted_links(c.g.links(), hits(c)))


def nodes_merged(c):
    return c.once("nodes_after_merge", lambda: P.merge_delete_nodes(c.g.nodes(), hits(c)))


# ------------------------------------------------------------------ audit
_PARAM_OF = {
    "full_name_arg": ("deleteTable", "deleteSchema", "getTable"),
    "job_id": ("deleteJob", "delete"),
    "pipelineId": ("deletePipeline",),
    "notebookId": ("deleteNotebook",),
    "dashboardId": ("deleteDashboard",),
    "queryId": ("deleteQuery", "deleteQueryDraft"),
}
_AUDIT_SQL_COLS = ", ".join(
    f"CASE WHEN action_name IN ({', '.join(repr(a) for a in acts)}) THEN COALESCE(full_name_arg, object_id) END AS {p}"
    for p, acts in _PARAM_OF.items())


@register("audit_scan", W(f"""
SELECT strftime(CAST(event_date AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f') AS event_time, action_name, service_name,
       {_AUDIT_SQL_COLS}
FROM audit_fx""", "audit_fx"))
def q_audit_scan(c):
    return audit_flat(c)


@register("delete_action_filter", W(f"""
SELECT {O.d('event_date')}, action_name, schema_table_name, deleted_entity_path FROM deletions""", "deletions"))
def q_delete_action_filter(c):
    return dels(c)


@register("deleted_name", W(f"""
SELECT action_name, full_name_arg,
       CASE WHEN action_name = 'deleteTable' THEN full_name_arg
            WHEN action_name = 'deleteSchema' THEN full_name_arg || '%' END AS schema_table_name
FROM (SELECT action_name, {_AUDIT_SQL_COLS} FROM audit_fx) a""", "audit_fx"))
def q_deleted_name(c):
    a = audit_flat(c)
    return a.select("action_name", "full_name_arg",
                    P.deleted_name("action_name", "full_name_arg").alias("schema_table_name"))


@register("deleted_path", W(f"""
SELECT action_name, service_name, {O.deleted_path_sql()} AS deleted_entity_path
FROM audit_fx""", "audit_fx"))
def q_deleted_path(c):
    a = audit_flat(c)
    params = {k: k for k in _PARAM_OF}
    return a.select("action_name", "service_name",
                    P.deleted_path("action_name", "service_name", params, c.host).alias("deleted_entity_path"))


# ------------------------------------------------------------- deletions
_HIT_SQL = "SELECT node, node_type, entity_path, action_name, schema_table_name FROM deleted"


@register("deleted_entities", W(_HIT_SQL, "deleted"))
def q_deleted_entities(c):
    return P.spread_hits(hits(c))


@register("merge_delete_links", W(f"SELECT {O.LINK_COLS} FROM links_after_merge", "links_after_merge"))
def q_merge_delete_links(c):
    return links_merged(c)


@register("match_deleted_links", W(f"""
SELECT {O.LINK_COLS} FROM links EXCEPT ALL SELECT {O.LINK_COLS} FROM links_after_merge""",
                                  "links", "links_after_merge"))
def q_match_deleted_links(c):
    return c.g.links().exceptAll(links_merged(c))


@register("delete_orphan_links", W(f"SELECT {O.LINK_COLS} FROM links_purged", "links_purged"))
def q_delete_orphan_links(c):
    return P.drop_orphan_links(links_merged(c), ids(c))


@register("merge_delete_nodes", W(f"SELECT {O.NODE_COLS} FROM nodes_after_merge", "nodes_after_merge"))
def q_merge_delete_nodes(c):
    return nodes_merged(c)


@register("delete_orphan_nodes", W(f"SELECT {O.NODE_COLS} FROM nodes_purged", "nodes_purged"))
def q_delete_orphan_nodes(c):
    return P.drop_orphan_nodes(nodes_merged(c), ids(c))


@register("null_aware_not_in", W(f"""
SELECT {O.NODE_COLS} FROM nodes WHERE node_type = {T} AND node NOT IN (SELECT table_id FROM valid_ids)""",
                                "nodes", "valid_ids"))
def q_null_aware_not_in(c):
    return P.orphan_nodes(c.g.nodes(), ids(c))


_NONCOMP = f"""SELECT {O.NODE_COLS} FROM nodes
ANTI JOIN (SELECT table_id AS node FROM valid_ids) known USING (node) WHERE node_type = {T}"""


@register("non_compliant_nodes", W(_NONCOMP, "nodes", "valid_ids"))
def q_non_compliant_nodes(c):
    return P.non_compliant_nodes(c.g.nodes(), ids(c))


@register("non_compliant_count", W(f"SELECT count(*) AS non_compliant FROM ({_NONCOMP}) x", "nodes", "valid_ids"))
def q_non_compliant_count(c):
    return P.non_compliant_nodes(c.g.nodes(), ids(c)).agg(F.count(F.lit(1)).alias("non_compliant"))


@register("delete_metrics", W("""
SELECT 'links' AS "table", (SELECT count(*) FROM links) - (SELECT count(*) FROM links_after_merge) AS merge_deleted,
       (SELECT count(*) FROM links_after_merge) - (SELECT count(*) FROM links_purged) AS orphan_deleted,
       (SELECT count(*) FROM links) - (SELECT count(*) FROM links_purged) AS total_deleted
UNION ALL
SELECT 'nodes', (SELECT count(*) FROM nodes) - (SELECT count(*) FROM nodes_after_merge),
       (SELECT count(*) FROM nodes_after_merge) - (SELECT count(*) FROM nodes_purged),
       (SELECT count(*) FROM nodes) - (SELECT count(*) FROM nodes_purged)""", "links_purged", "nodes_purged"))
def q_delete_metrics(c):
    links = P.flag_orphans(links_merged(c), ids(c), P.LINK_ENDS)
    nodes = P.flag_orphans(nodes_merged(c), ids(c), P.NODE_ENDS)
    return P.delete_metrics(c.g.links(), links, "links").unionByName(P.delete_metrics(c.g.nodes(), nodes, "nodes"))


# ------------------------------------------------------------- retention
@register("retention_links", W(f"""
SELECT {O.LINK_COLS} FROM links WHERE NOT (last_event_date < {O.PURGE_CUTOFF_SQL}) OR last_event_date IS NULL""",
                              "links"))
def q_retention_links(c):
    return U.retain(c.g.links(), c.as_of, PURGE_DAYS)


@register("retention_nodes", W(f"""
SELECT {O.NODE_COLS} FROM nodes WHERE NOT (last_event_date < {O.PURGE_CUTOFF_SQL}) OR last_event_date IS NULL""",
                              "nodes"))
def q_retention_nodes(c):
    return U.retain(c.g.nodes(), c.as_of, PURGE_DAYS)


# ---------------------------------------------------------------- upserts
def batch(c, which: str) -> GraphBuild:
    key = f"batch:{which}"
    if key not in c.memo:
        ev = c.fx.events()
        split = F.lit(UPSERT_SPLIT.isoformat()).cast("date")
        ev = ev.filter(F.col("event_date") < split) if which == "target" else ev.filter(F.col("event_date") >= split)
        c.memo[key] = GraphBuild(ev, c.params, c.fx.inventory(), c.fx.legacy())
    return c.memo[key]


def _merge_sql(prefix_t, prefix_s, table, keys, cols):
    on = " AND ".join(f"t.{k} = s.{k}" for k in keys)
    take_s = "t.p IS NULL OR (s.p IS NOT NULL AND t.last_event_date <= s.last_event_date)"
    sel = ", ".join(
        (f"CAST(CASE WHEN {take_s} THEN s.{c} ELSE t.{c} END AS VARCHAR) AS {c}" if c == "last_event_date"
         else f"CASE WHEN {take_s} THEN s.{c} ELSE t.{c} END AS {c}") for c in cols)
    body = f"""FROM (SELECT *, 1 AS p FROM {prefix_t}{table}) t
FULL OUTER JOIN (SELECT *, 1 AS p FROM {prefix_s}{table}) s ON {on}"""
    return sel, body, take_s


_LCOLS = ["source_node", "source_node_type", "target_node", "target_node_type", "entity_path", "last_event_date",
          "lineage_source_table"]
_NCOLS = ["node", "node_type", "entity_path", "last_event_date", "lineage_source_table"]
_LSEL, _LBODY, _ = _merge_sql("t_", "s_", "links", U.LINK_KEYS, _LCOLS)
_NSEL, _NBODY, _ = _merge_sql("t_", "s_", "nodes", U.NODE_KEYS, _NCOLS)


@register("links_upsert", W(f"SELECT {_LSEL} {_LBODY}", "t_links", "s_links"))
def q_links_upsert(c):
    return U.upsert(batch(c, "target").links(), batch(c, "source").links(), U.LINK_KEYS)


@register("nodes_upsert", W(f"SELECT {_NSEL} {_NBODY}", "t_nodes", "s_nodes"))
def q_nodes_upsert(c):
    return U.upsert(batch(c, "target").nodes(), batch(c, "source").nodes(), U.NODE_KEYS)


def _metrics_sql(body, name):
    return f"""SELECT '{name}' AS "table",
  CAST(count(*) FILTER (WHERE t.p IS NULL) AS BIGINT) AS inserted,
  CAST(count(*) FILTER (WHERE t.p IS NOT NULL AND s.p IS NOT NULL AND t.last_event_date <= s.last_event_date)
       AS BIGINT) AS updated
{body}"""


@register("upsert_metrics", W(f"{_metrics_sql(_LBODY, 'links')} UNION ALL {_metrics_sql(_NBODY, 'nodes')}",
                              "t_links", "s_links", "t_nodes", "s_nodes"))
def q_upsert_metrics(c):
    out = None
    for name, keys, getter in (("links", U.LINK_KEYS, "links"), ("nodes", U.NODE_KEYS, "nodes")):
        t = getattr(batch(c, "target"), getter)()
        s = getattr(batch(c, "source"), getter)()
        m = (U.upsert_metrics(t, s, keys)
             .agg(F.lit(name).alias("table"),
                  F.coalesce(F.sum(F.when(F.col("action") == "inserted", F.col("rows"))), F.lit(0))
                  .cast("long").alias("inserted"),
                  F.coalesce(F.sum(F.when(F.col("action") == "updated", F.col("rows"))), F.lit(0))
                  .cast("long").alias("updated")))
        out = m if out is None else out.unionByName(m)
    return out


# ------------------------------------------------------------------ sinks
GRAPH_SCHEMA = "edgeloom_graph"


def _graph_schema(c) -> str:
    from edgeloom.session import ensure_checkpoint_dir
    from edgeloom.sources.sinks import ensure_schema
    root = ensure_checkpoint_dir(c.spark).rstrip("/")
    ensure_schema(c.spark, GRAPH_SCHEMA, f"{root}/warehouse/{GRAPH_SCHEMA}.db")
    return GRAPH_SCHEMA


def _fresh_table(c, kind: str, df, keys):
    """Create the table through the sink, new for each call, and read it back."""
    from edgeloom.sources.sinks import save_or_upsert
    table = f"{_graph_schema(c)}.lineage_{kind}_{uuid.uuid4().hex}"
    save_or_upsert(df, table, keys, U.ORDER_COL)
    return c.spark.table(table).select(*df.columns)


@register("bootstrap_schema", W(f"SELECT {O.NODE_COLS} FROM nodes", "nodes"))
def q_bootstrap_schema(c):
    """Schema created on first use; the node table is written into it and read back."""
    return _fresh_table(c, "nodes", c.g.nodes(), U.NODE_KEYS)


@register("create_if_absent", W(f"SELECT {O.LINK_COLS} FROM links", "links"))
def q_create_if_absent(c):
    """First run writes the links of all events as the table."""
    return _fresh_table(c, "links", c.g.links(), U.LINK_KEYS)


# ------------------------------------------------------------- strict mode
@register("deleted_entities_strict", W(
    "SELECT node, node_type, entity_path, action_name, schema_table_name FROM deleted_strict", "deleted_strict"))
def q_deleted_entities_strict(c):
    d = c.once("deletions_strict", lambda: P.deletions(audit_flat(c), c.host, c.as_of, c.days, "strict"))
    return P.deleted_entities(c.g.nodes(), d, "strict")


def _strict_orphan(col, typ):
    return (f"({typ} = {T} AND {col} NOT IN (SELECT table_id FROM valid_ids) "
            f"AND NOT coalesce(contains({col}, '://'), false))")


@register("delete_orphan_links_strict", W(f"""
SELECT {O.LINK_COLS} FROM links
WHERE ({_strict_orphan('source_node', 'source_node_type')} OR {_strict_orphan('target_node', 'target_node_type')})
      IS NOT TRUE""", "links", "valid_ids"))
def q_delete_orphan_links_strict(c):
    return P.drop_orphan_links(c.g.links(), ids(c), "strict")


@register("delete_orphan_nodes_strict", W(f"""
SELECT {O.NODE_COLS} FROM nodes WHERE {_strict_orphan('node', 'node_type')} IS NOT TRUE""", "nodes", "valid_ids"))
def q_delete_orphan_nodes_strict(c):
    return P.drop_orphan_nodes(c.g.nodes(), ids(c), "strict")


def _merge_sql_ns(table, keys, cols):
    on = " AND ".join(f"t.{k} IS NOT DISTINCT FROM s.{k}" for k in keys)
    take_s = "t.p IS NULL OR (s.p IS NOT NULL AND t.last_event_date <= s.last_event_date)"
    sel = ", ".join(
        (f"CAST(CASE WHEN {take_s} THEN s.{c} ELSE t.{c} END AS VARCHAR) AS {c}" if c == "last_event_date"
         else f"CASE WHEN {take_s} THEN s.{c} ELSE t.{c} END AS {c}") for c in cols)
    return f"""SELECT {sel} FROM (SELECT *, 1 AS p FROM t_{table}) t
FULL OUTER JOIN (SELECT *, 1 AS p FROM s_{table}) s ON {on}"""


@register("links_upsert_strict", W(_merge_sql_ns("links", U.LINK_KEYS, _LCOLS), "t_links", "s_links"))
def q_links_upsert_strict(c):
    return U.upsert(batch(c, "target").links(), batch(c, "source").links(), U.LINK_KEYS, null_safe=True)


@register("nodes_upsert_strict", W(_merge_sql_ns("nodes", U.NODE_KEYS, _NCOLS), "t_nodes", "s_nodes"))
def q_nodes_upsert_strict(c):
    return U.upsert(batch(c, "target").nodes(), batch(c, "source").nodes(), U.NODE_KEYS, null_safe=True)


# ------------------------------------------------- tables kept up to date
def _table(c, kind: str) -> str:
    return f"{_graph_schema(c)}.{kind}_{uuid.uuid4().hex}"


def _upserted(c, kind: str, keys, watch=None) -> str:
    """Both batches through the partition merge into a new table."""
    from edgeloom.sources.sinks import save_or_upsert
    table = _table(c, kind)
    for which in ("target", "source"):
        save_or_upsert(getattr(batch(c, which), kind)(), table, keys, U.ORDER_COL, watch=watch)
    return table


@register("links_upsert_table", W(f"SELECT {_LSEL} {_LBODY}", "t_links", "s_links"))
def q_links_upsert_table(c):
    """The upsert as the job does it: only the partitions that the second batch changes are written again."""
    return c.spark.table(_upserted(c, "links", U.LINK_KEYS)).select(*_LCOLS)


@register("nodes_upsert_table", W(f"SELECT {_NSEL} {_NBODY}", "t_nodes", "s_nodes"))
def q_nodes_upsert_table(c):
    return c.spark.table(_upserted(c, "nodes", U.NODE_KEYS)).select(*_NCOLS)


@register("retention_links_table", W(f"""
SELECT {O.LINK_COLS} FROM links WHERE NOT (last_event_date < {O.PURGE_CUTOFF_SQL}) OR last_event_date IS NULL""",
                                    "links"))
def q_retention_links_table(c):
    """Retention as the job does it: partitions of earlier dates are dropped, no row is written."""
    from edgeloom.functions.columns import as_date, window_start
    from edgeloom.sources.sinks import create_table, retire_partitions
    table = _table(c, "links")
    create_table(c.g.links(), table, U.ORDER_COL)
    retire_partitions(c.spark, table, window_start(as_date(c.as_of), PURGE_DAYS))
    return c.spark.table(table).select(*_LCOLS)


@register("edges_incremental", W(f"SELECT {O.EDGE_COLS} FROM edges", "edges"))
def q_edges_incremental(c):
    """Edges from day maxima stored by three runs: the later half of the days, one half of every day before, all."""
    from edgeloom.operators.daily import edges_of_days, refresh_days
    ev, table = c.fx.events(), _table(c, "edge_days")
    late = F.col("event_date") >= F.lit(UPSERT_SPLIT.isoformat()).cast("date")
    for part in (ev.filter(late), ev.filter(late | (F.xxhash64("entity_id") % 2 == 0)), ev):
        refresh_days(c.spark, part, table, c.params.workspace, c.host, c.as_of, c.days)
    return edges_of_days(c.spark, table, c.as_of, c.days)


_MERGED_DEGREES = O._COUNTS.format(total="if(n_out = n_in, n_out, n_out + n_in)").replace(
    "FROM links)", f"FROM (SELECT {_LSEL} {_LBODY}) merged)")


@register("total_connections_kept", W(f"SELECT id AS node, total_connections FROM ({_MERGED_DEGREES}) counted", "t_links", "s_links"))
def q_total_connections_kept(c):
    """Degrees from the counts that each upsert has added to and taken from, not from the links."""
    from edgeloom.operators import degree as deg
    from edgeloom.session import stage
    deltas = []
    _upserted(c, "links", U.LINK_KEYS, lambda before, after: deltas.append(stage(deg.degree_delta(before, after))))
    first = deg.degree_counts(c.g.links().limit(0))
    return deg.connections_of(deg.merge_degrees(first, deltas))
