"""Deletion purge: assets deleted in the audit log, links and nodes that point
at them, and rows whose table no longer exists.

The reference writes these as MERGE / DELETE conditions with OR, LIKE and
``NOT IN`` subqueries, which Spark can only run as nested-loop joins. Each OR
branch becomes its own equi join here (the branches are disjoint or their
anti joins compose), LIKE becomes the keyed join of :mod:`.patterns`, and
``NOT IN`` becomes a join of only the rows for which it is asked, guarded by the
one-row facts that decide its NULL semantics (whether the id list is empty or
holds a NULL).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.columns import as_col, explore_prefix, window_start
from edgeloom.functions.constants import (
    DASHBOARD_URL_FORMS,
    DELETE_ACTIONS,
    DELETE_URL_PATHS,
    JOBS_SERVICE,
    LIKE_DELETE_ACTIONS,
    TABLE_NODE_TYPE,
)
from edgeloom.operators.patterns import like_join, like_semi_values
from edgeloom.session import stage


def escape_like(c: Column) -> Column:
    """Make every character of ``c`` literal inside a LIKE pattern (escape ``\\``)."""
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    c = F.replace(c, F.lit("%"), F.lit("\\%"))
    return F.replace(c, F.lit("_"), F.lit("\\_"))


def deleted_name(action, full_name, mode: str = "reference") -> Column:
    """Name a deletion removes: the table name, or a pattern for the schema's tables.

    ``reference``: schema name + ``%`` (``_`` in the name is a wildcard and
    ``main.s1`` also hits ``main.s10``); ``strict``: the literal schema name
    followed by ``.`` and ``%``.
    """
    a, n = as_col(action), as_col(full_name)
    schema = F.concat(n, F.lit("%")) if mode == "reference" else F.concat(escape_like(n), F.lit(".%"))
    return F.when(a == "deleteTable", n).when(a == "deleteSchema", schema)


def deleted_path(action, service, params: dict, host: str, mode: str = "reference") -> Column:
    """URL (or LIKE pattern) of the deleted asset; NULL for deletions without one
    (``deleteJob``, ``delete`` outside the jobs service).

    ``params`` maps request parameter names to columns. In ``strict`` mode the
    schema pattern is literal up to its ``/%`` (see :func:`deleted_name`).
    """
    a, s = as_col(action), as_col(service)
    p = {k: as_col(v) for k, v in params.items()}
    ex = explore_prefix(host)
    dotted = F.replace(p["full_name_arg"], F.lit("."), F.lit("/"))
    schema_dir = dotted if mode == "reference" else escape_like(dotted)
    expr = (F.when(a == "deleteTable", F.concat(F.lit(ex), dotted))
            .when(a == "deleteSchema", F.concat(F.lit(ex), schema_dir, F.lit("/%"))))
    for act, path, param in DELETE_URL_PATHS:
        cond = (a == act) & (s == JOBS_SERVICE) if act == "delete" else a == act
        expr = expr.when(cond, F.concat(F.lit(f"https://{host}{path}"), p[param]))
    return expr


def filter_deletes(audit: DataFrame, as_of, days: int) -> DataFrame:
    """Deletion actions inside the window (inclusive)."""
    return audit.filter(F.col("action_name").isin(*DELETE_ACTIONS)
                        & (F.to_date("event_time") >= window_start(as_of, days)))


def deletions(audit_flat: DataFrame, host: str, as_of, days: int, mode: str = "reference") -> DataFrame:
    """``(event_date, action_name, schema_table_name, deleted_entity_path)`` per
    deletion; ``audit_flat`` is :func:`edgeloom.sources.scans.audit_scan` output.

    ``strict``: a dashboard deletion gives its two exact URLs (legacy and v3
    form) instead of the ``dashboards%/id`` pattern.
    """
    params = {k: k for k in ("full_name_arg", "job_id", "pipelineId", "notebookId", "dashboardId", "queryId")}
    out = filter_deletes(audit_flat, as_of, days).select(
        F.to_date("event_time").alias("event_date"),
        "action_name",
        deleted_name("action_name", "full_name_arg", mode).alias("schema_table_name"),
        deleted_path("action_name", "service_name", params, host, mode).alias("deleted_entity_path"),
        F.col("dashboardId"),
    )
    if mode == "strict":
        forms = F.array(*[F.concat(F.lit(f"https://{host}{p}"), F.col("dashboardId"))
                          for p in DASHBOARD_URL_FORMS])
        dash = out.filter(F.col("action_name") == "deleteDashboard").withColumn("deleted_entity_path",
                                                                               F.explode(forms))
        out = out.filter(~F.coalesce(F.col("action_name") == "deleteDashboard", F.lit(False))).unionByName(dash)
    return out.drop("dashboardId")


_HIT_COLS = ("node", "node_type", "entity_path", "action_name", "schema_table_name")


# Rows that one task makes of hits with a count, and rows made of one piece of a hit.
ROWS_PER_TASK, ROWS_PER_PIECE = 250_000, 1_000


def spread_hits(hits: DataFrame) -> DataFrame:
    """Hits with a count ``n`` as ``n`` rows each.

    A hit's rows are cut into pieces and the pieces dealt evenly, so neither a schema that was deleted many times
    nor the number of tasks that made the hits decides how the rows are spread.
    """
    total = hits.agg(F.sum("n")).first()[0] or 0
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / ROWS_PER_PIECE)))
    size = F.least(F.lit(ROWS_PER_PIECE).cast("long"), F.col("n") - F.col("_at") * ROWS_PER_PIECE).cast("int")
    return (hits.withColumn("_at", piece).repartition(max(1, -(-total // ROWS_PER_TASK)))
            .select(*_HIT_COLS, F.explode(F.array_repeat(F.lit(True), size)).alias("_row")).select(*_HIT_COLS))


def deleted_entities(nodes: DataFrame, dels: DataFrame, mode: str = "reference", counted: bool = False) -> DataFrame:
    """Nodes hit by a deletion that happened after their last event (strict ``>``).

    Schema and dashboard deletions match the node URL with LIKE; the others
    by equality. The two branches are disjoint per deletion row, so the UNION
    ALL of an equi join and a keyed LIKE join equals the reference's OR join.

    Deletions that repeat each other but for the date meet a node once, with their number by date (one entry per
    day of the window at most). ``counted``: one row per node and such deletions, with ``n``, their number;
    otherwise a row for each of them.
    """
    n = nodes.select("node", "node_type", "entity_path", "last_event_date")
    like_actions = LIKE_DELETE_ACTIONS if mode == "reference" else ("deleteSchema",)
    like = F.col("action_name").isin(*like_actions)
    once = ["action_name", "schema_table_name", "deleted_entity_path"]
    dels = (dels.filter(F.col("deleted_entity_path").isNotNull() & F.col("event_date").isNotNull())
            .groupBy(*once, "event_date").agg(F.count(F.lit(1)).alias("_n"))
            .groupBy(*once).agg(F.collect_list(F.struct("event_date", "_n")).alias("_days")))
    dels = stage(dels)
    eq_d, lk_d = dels.filter(~like), dels.filter(like)
    eq_hits = n.join(eq_d, n["entity_path"] == eq_d["deleted_entity_path"])
    lk_hits = like_join(n, "entity_path", lk_d, "deleted_entity_path")
    cols = [*n.columns, "action_name", "schema_table_name", "_days"]
    hits = eq_hits.select(*cols).unionByName(lk_hits.select(*cols))
    after = F.expr("aggregate(_days, 0L, (x, d) -> x + if(d.event_date > last_event_date, d._n, 0L))")
    # a list of one: Spark would else make the sum over the list part of the join's condition, which a broadcast join cannot run
    hits = hits.withColumn("n", F.explode(F.array(after))).filter(F.col("n") > 0).select(*_HIT_COLS, "n")
    return hits if counted else spread_hits(stage(hits))


def match_deleted_links(links: DataFrame, deleted: DataFrame) -> DataFrame:
    """Links left after the merge-delete: a link goes when its target or source
    is a hit node (name and type), or its source equals a deleted table name,
    or matches a deleted schema's pattern (LIKE, so ``_`` is a wildcard)."""
    hit = deleted.select("node", "node_type").distinct()
    # sources that go by name alone: deleted tables and what the schemas' patterns match
    tables = deleted.filter(F.col("action_name") == "deleteTable").select(F.col("schema_table_name").alias("source_node"))
    schemas = deleted.filter(F.col("action_name") == "deleteSchema").select("schema_table_name")
    named = tables.unionByName(like_semi_values(links, "source_node", schemas, "schema_table_name")).distinct()
    out = links.join(hit.select(F.col("node").alias("target_node"), F.col("node_type").alias("target_node_type")),
                     ["target_node", "target_node_type"], "left_anti")
    out = out.join(hit.select(F.col("node").alias("source_node"), F.col("node_type").alias("source_node_type")),
                   ["source_node", "source_node_type"], "left_anti")
    return out.join(named, "source_node", "left_anti")


def merge_delete_nodes(nodes: DataFrame, deleted: DataFrame) -> DataFrame:
    """Nodes left after removing hits equal on name, type and URL (``=``: a NULL
    URL never matches, so such nodes are never purged this way)."""
    return nodes.join(deleted.select("node", "node_type", "entity_path").distinct(),
                      ["node", "node_type", "entity_path"], "left_anti")


def id_facts(ids: DataFrame, col: str = "table_id") -> tuple[int, int]:
    """``(rows, NULL rows)`` of the id list: the two facts ``NOT IN`` depends on."""
    r = ids.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(col).isNull(), 1)).alias("z")).first()
    return int(r["n"]), int(r["z"])


def _asked(type_col: str, col: str, facts: tuple[int, int], strict: bool) -> Column:
    """Rows for which ``col NOT IN (ids)`` is asked at all: table-typed ones with a value (and, in ``strict`` mode, no
    path, which is never a table id). ``facts`` settle the rest: one NULL id makes every answer unknown."""
    if facts[1] > 0:
        return F.lit(False)
    ask = F.col(type_col) == TABLE_NODE_TYPE
    if facts[0] > 0:
        ask = ask & F.col(col).isNotNull()
    if strict:
        ask = ask & F.coalesce(~F.col(col).contains("://"), F.lit(True))
    return F.coalesce(ask, F.lit(False))


def flag_orphans(df: DataFrame, ids: DataFrame, ends: list[tuple[str, str]], mode: str = "reference",
                 facts: tuple[int, int] | None = None) -> DataFrame:
    """``df`` with ``_orphan``: one of ``ends`` (type column, id column) is table-typed and not a valid id.

    Only rows for which the question is asked meet the ids, and each of them is
    moved once per end; all others (jobs, notebooks, queries, paths in strict
    mode, ids that are settled by the NULL rules) pass without a shuffle. An empty id
    list answers without a join.
    """
    facts = facts or id_facts(ids)
    known = ids.select(F.col("table_id").alias("_id")).distinct()
    out = df.withColumn("_orphan", F.lit(False))
    for type_col, col in ends:
        ask = _asked(type_col, col, facts, mode == "strict")
        if facts[0] == 0:
            out = out.withColumn("_orphan", F.col("_orphan") | ask)
        elif facts[1] == 0:
            met = out.filter(ask).join(known, F.col(col) == F.col("_id"), "left")
            met = met.withColumn("_orphan", F.col("_orphan") | F.col("_id").isNull()).drop("_id")
            out = out.filter(~ask).unionByName(met)
    return out


LINK_ENDS = [("source_node_type", "source_node"), ("target_node_type", "target_node")]
NODE_ENDS = [("node_type", "node")]


def _drop_orphans(df: DataFrame, ids: DataFrame, ends, mode: str, facts) -> DataFrame:
    """Rows without an orphan end: of those asked, the ones that the ids hold (a semi join per end)."""
    facts = facts or id_facts(ids)
    for type_col, col in ends:
        ask = _asked(type_col, col, facts, mode == "strict")
        rest = df.filter(~ask)
        if facts[0] == 0:
            df = rest
        elif facts[1] == 0:
            df = rest.unionByName(df.filter(ask).join(ids.select(F.col("table_id").alias(col)), col, "left_semi").select(*df.columns))
    return df


def drop_orphan_links(links: DataFrame, ids: DataFrame, mode: str = "reference",
                      facts: tuple[int, int] | None = None) -> DataFrame:
    """Delete links whose table-typed source or target is not a valid id.

    ``NOT IN`` semantics: one NULL id disables the delete; an empty id list
    deletes every table-typed endpoint. ``strict`` keeps path endpoints (``://``).
    ``links`` is read once per branch: pass a scan or a staged frame.
    """
    return _drop_orphans(links, ids, LINK_ENDS, mode, facts)


def orphan_nodes(nodes: DataFrame, ids: DataFrame, mode: str = "reference") -> DataFrame:
    """Table-typed nodes for which ``node NOT IN (ids)`` is TRUE: an anti join of just those nodes."""
    facts = id_facts(ids)
    asked = nodes.filter(_asked("node_type", "node", facts, mode == "strict"))
    if facts[0] == 0 or facts[1] > 0:
        return asked
    return asked.join(ids.select(F.col("table_id").alias("node")), "node", "left_anti").select(*nodes.columns)


def drop_orphan_nodes(nodes: DataFrame, ids: DataFrame, mode: str = "reference",
                      facts: tuple[int, int] | None = None) -> DataFrame:
    """Delete table-typed nodes that are not a valid id (same ``NOT IN`` rules)."""
    return _drop_orphans(nodes, ids, NODE_ENDS, mode, facts)


def non_compliant_nodes(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Table-typed nodes without a valid id (plain anti join: a NULL id only
    fails to match, it does not disable anything)."""
    return (nodes.join(ids.select(F.col("table_id").alias("node")), "node", "left_anti")
            .filter(F.col("node_type") == TABLE_NODE_TYPE))


def delete_metrics(before: DataFrame, flagged: DataFrame, table: str) -> DataFrame:
    """Rows removed by the merge-delete and by the orphan delete.

    ``flagged``: what the merge-delete leaves, with ``_orphan`` (:func:`flag_orphans`). The orphan plan runs once, for
    both numbers.
    """
    tagged = (before.select(F.lit(True).alias("_b"), F.lit(False).alias("_o"))
              .unionByName(flagged.select(F.lit(False).alias("_b"), F.col("_orphan").alias("_o"))))
    n = F.count(F.when(F.col("_b"), 1))
    left, orphan = F.count(F.when(~F.col("_b"), 1)), F.count(F.when(F.col("_o"), 1))
    return tagged.agg(
        F.lit(table).alias("table"),
        (n - left).cast("long").alias("merge_deleted"),
        orphan.cast("long").alias("orphan_deleted"),
        (n - left + orphan).cast("long").alias("total_deleted"),
    )
