"""Joins on ``value LIKE pattern`` where the pattern is a column.

Spark plans a non-equi join condition as a nested-loop join, which compares
every value with every pattern. Here each pattern gets one equi-join key that
every value it matches must share, taken from its literal ends (the text before
its first wildcard and after its last one):

* ``whole``: a pattern without wildcards matches itself only;
* ``name``: a suffix with a slash fixes the value's last path segment;
* ``folder``: a prefix with a slash fixes the value's path up to that slash;
* ``start`` / ``end``: other ends fix the value's first or last characters, in
  the end's full length.

Of the keys that a pattern offers, the one that the fewest patterns share is
taken. ``.../dashboards%/<id>`` so joins on ``<id>`` and ``.../main/s1/%`` on its
folder, whatever the length of the host name. A value is listed under the
lengths and depths that some pattern uses. LIKE itself then runs once per
distinct (value, pattern) pair of one key, and matches are joined back to the
rows with equi joins, so repeated patterns and repeated values cost nothing
extra. A pattern without any literal end (such as ``%x%``) is compared with every
value, as in any LIKE join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.session import stage

# Kinds of keys, the more selective first (ties in the number of patterns).
WHOLE, NAME, FOLDER, START, END, ANY = range(6)


def literal_prefix(pattern: Column) -> Column:
    """Text before the first ``%``, ``_`` or escape character."""
    return F.regexp_extract(pattern, r"^([^%_\\]*)", 1)


def literal_suffix(pattern: Column) -> Column:
    """Text after the last ``%``, ``_`` or escape character."""
    return F.regexp_extract(pattern, r"([^%_\\]*)$", 1)


def _slashes(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit("")))


def bucket_patterns(patterns: DataFrame, pattern_col: str) -> DataFrame:
    """``patterns`` (distinct) with the key each one is joined on: ``_kind, _arg, _bkey``."""
    p = F.col(pattern_col)
    ends = patterns.withColumn("_pre", literal_prefix(p)).withColumn("_suf", literal_suffix(p))
    pre, suf = F.col("_pre"), F.col("_suf")
    offer = lambda kind, arg, key, when: F.when(when, F.struct(
        F.lit(kind).alias("_kind"), arg.cast("int").alias("_arg"), key.alias("_bkey")))
    zero, last = F.lit(0), F.substring_index(suf, "/", -1)
    offers = stage(ends.select(pattern_col, F.inline(F.array_compact(F.array(
        offer(WHOLE, zero, p, pre == p),
        offer(NAME, zero, last, suf.contains("/") & (last != "")),
        offer(FOLDER, _slashes(pre), F.regexp_extract(pre, r"^(.*)/", 1), pre.contains("/")),
        offer(START, F.length(pre), pre, pre != ""),
        offer(END, F.length(suf), suf, suf != ""),
        offer(ANY, zero, F.lit(""), (pre == "") & (suf == "")))))))
    shared = offers.groupBy("_kind", "_arg", "_bkey").agg(F.count(F.lit(1)).alias("_n"))
    return (offers.join(shared, ["_kind", "_arg", "_bkey"])
            .groupBy(pattern_col).agg(F.min(F.struct("_n", "_kind", "_arg", "_bkey")).alias("_o"))
            .select(pattern_col, "_o._kind", "_o._arg", "_o._bkey"))


def bucket_values(values: DataFrame, value_col: str, used) -> DataFrame:
    """One row per (kind, arg) in ``used`` with the value's own key; none where the value is too short for it."""
    v = F.col(value_col)
    rows = []
    for kind, arg in used:
        key = {WHOLE: v, NAME: F.substring_index(v, "/", -1), START: F.left(v, F.lit(arg)), END: F.right(v, F.lit(arg)),
               FOLDER: F.when(_slashes(v) >= arg, F.substring_index(v, "/", arg)), ANY: F.lit("")}[kind]
        rows.append(F.struct(F.lit(kind).alias("_kind"), F.lit(arg).alias("_arg"), key.alias("_bkey")))
    return values.select("*", F.inline(F.array(*rows))).filter(F.col("_bkey").isNotNull())


def like_pairs(values: DataFrame, value_col: str, patterns: DataFrame, pattern_col: str) -> DataFrame:
    """Distinct ``(value, pattern)`` pairs with ``value LIKE pattern``."""
    # NULL values or patterns never satisfy LIKE.
    v = values.select(value_col).filter(F.col(value_col).isNotNull()).distinct()
    p = patterns.select(pattern_col).filter(F.col(pattern_col).isNotNull()).distinct()
    # The bucketed patterns (one row per distinct pattern) are staged: the
    # lookup below reads them anyway, and the join then sees a plain scan
    # instead of the expressions that derived the patterns, which Catalyst's
    # constraint propagation would otherwise copy across the join keys.
    bp = stage(bucket_patterns(p, pattern_col))
    # Values are listed only under what some pattern uses: a few pairs of
    # numbers (kinds, and lengths or depths of literal ends) reach the driver.
    used = sorted((r[0], r[1]) for r in bp.select("_kind", "_arg").distinct().collect()) or [(WHOLE, 0)]
    bv = bucket_values(v, value_col, used)
    return (bv.join(bp, ["_kind", "_arg", "_bkey"])
            .filter(F.like(F.col(value_col), F.col(pattern_col)))
            .select(value_col, pattern_col))


def like_join(values: DataFrame, value_col: str, patterns: DataFrame, pattern_col: str) -> DataFrame:
    """Inner join of ``values`` and ``patterns`` on ``values.value_col LIKE patterns.pattern_col``."""
    pairs = like_pairs(values, value_col, patterns, pattern_col)
    return values.join(pairs, value_col).join(patterns, pattern_col)


def like_semi_values(values: DataFrame, value_col: str, patterns: DataFrame, pattern_col: str) -> DataFrame:
    """Distinct values of ``value_col`` matched by at least one pattern."""
    return like_pairs(values, value_col, patterns, pattern_col).select(value_col).distinct()
