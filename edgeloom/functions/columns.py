"""Column-level rules (Spark built-ins only, so they stay inside codegen)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from edgeloom.functions.constants import (
    DASHBOARD_NODE_TYPE,
    DASHBOARD_TYPES,
    ENTITY_URL_PATHS,
    EXPLORE_PATH,
    JOB_NODE_TYPE,
    JOB_TYPES,
    QUERY_NODE_TYPE,
    QUERY_TYPE,
    TABLE_LIKE_TYPES,
    TABLE_NODE_TYPE,
)

__all__ = [
    "as_col",
    "as_date",
    "normalize_type",
    "entity_url",
    "explore_prefix",
    "table_url",
    "inventory_url",
    "object_name",
    "entity_node_id",
    "window_start",
    "undirected_pair_key",
    "http_date",
]


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_date(d) -> Column:
    """A DATE literal from a ``date`` / ISO string, or a column as is."""
    if isinstance(d, Column):
        return d
    if isinstance(d, (_dt.date, _dt.datetime)):
        d = d.isoformat()[:10]
    return F.lit(d).cast("date")


def normalize_type(c) -> Column:
    """Collapse raw object types into node types; unknown types pass through."""
    c = as_col(c)
    return (
        F.when(c.isin(*TABLE_LIKE_TYPES), F.lit(TABLE_NODE_TYPE))
        .when(c.isin(*DASHBOARD_TYPES), F.lit(DASHBOARD_NODE_TYPE))
        .when(c == QUERY_TYPE, F.lit(QUERY_NODE_TYPE))
        .when(c.isin(*JOB_TYPES), F.lit(JOB_NODE_TYPE))
        .otherwise(c)
    )


def entity_url(entity_type, entity_id, host: str) -> Column:
    """Link to the entity by its raw type; NULL for types without one."""
    t, i = as_col(entity_type), as_col(entity_id)
    expr = None
    for raw, path in ENTITY_URL_PATHS:
        val = F.concat(F.lit(f"https://{host}{path}"), i)
        expr = F.when(t == raw, val) if expr is None else expr.when(t == raw, val)
    return expr


def explore_prefix(host: str) -> str:
    return f"https://{host}{EXPLORE_PATH}"


def table_url(name, host: str) -> Column:
    """Catalog explorer link: every ``.`` of the full name becomes ``/``."""
    return F.concat(F.lit(explore_prefix(host)), F.replace(as_col(name), F.lit("."), F.lit("/")))


def inventory_url(catalog, schema, table, host: str) -> Column:
    """Explorer link from the three name parts (dots inside a part are kept)."""
    return F.concat(F.lit(explore_prefix(host)), as_col(catalog), F.lit("/"), as_col(schema),
                    F.lit("/"), as_col(table))


def object_name(full_name, path) -> Column:
    return F.coalesce(as_col(full_name), as_col(path))


def entity_node_id(node_type, entity_id) -> Column:
    """``type-id``; NULL when either part is NULL (``||`` semantics)."""
    return F.concat(as_col(node_type), F.lit("-"), as_col(entity_id))


def window_start(as_of, days: int) -> Column:
    """First date inside a window of ``days`` ending at ``as_of``."""
    return F.date_sub(as_date(as_of), int(days))


def undirected_pair_key(a, b, mode: str = "reference") -> list[Column]:
    """Partition key that is equal for a->b and b->a.

    ``reference``: the two names sorted and glued without a separator (so
    ``ab``+``c`` equals ``a``+``bc``). ``strict``: the sorted pair as two columns.
    """
    a, b = as_col(a), as_col(b)
    if mode == "strict":
        return [F.least(a, b), F.greatest(a, b)]
    return [F.concat_ws("", F.array_sort(F.array(a, b)))]


# Fixed value: how the served JSON writes dates (HTTP date, as Flask's encoder does).
HTTP_DATE_FORMAT = "EEE, dd MMM yyyy HH:mm:ss 'GMT'"


def http_date(c) -> Column:
    """DATE -> ``Tue, 30 Jan 2024 00:00:00 GMT``."""
    return F.date_format(as_col(c), HTTP_DATE_FORMAT)
