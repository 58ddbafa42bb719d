"""Secret scan through a trigram inverted index, in DataFrame functions only.

Every rule's regular expression is turned into a Boolean trigram query: an OR
of alternatives, each an AND of trigrams that any match must contain. The
postings of those trigrams are intersected, and a rule is verified only on the
documents its query leaves. A rule with an alternative that has no mandatory
trigram (a run of hex digits) scans every document.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.common import ascii_lower, table
from edgeloom.session import stage


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0      # the group whose length counts
    least: int = 1      # matches whose group is shorter are dropped
    any_case: bool = False


#: The three base rules of the contract, in its order. Runs of one class are
#: maximal either way, so the least length of access and hex may stand in the pattern itself.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Published token formats that the base rules do not name.
MORE = (
    Rule("forge", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


def _strings(tree) -> list[list[str]]:
    """Alternatives of a parsed pattern; each is the list of literal runs any match contains."""
    alts: list[tuple[list[str], str]] = [([], "")]       # closed runs, run still open

    def close(xs):
        return [(runs + [cur] if cur else runs, "") for runs, cur in xs]

    for op, arg in tree:
        if op is rc.LITERAL:
            alts = [(runs, cur + chr(arg).lower()) for runs, cur in alts]
        elif op is rc.SUBPATTERN:
            inner = _strings(arg[3])
            alts = close([(runs + [cur] if cur else runs, "") for runs, cur in alts])
            alts = [(runs + more, "") for runs, _ in alts for more in inner]
        elif op is rc.BRANCH:
            alts = [(runs + more, "") for runs, _ in close(alts) for b in arg[1] for more in _strings(b)]
        elif op is rc.MAX_REPEAT and arg[0] >= 1:
            alts = [(runs + more, "") for runs, _ in close(alts) for more in _strings(arg[2])]
        else:                                            # optional parts and classes end a run
            alts = close(alts)
    return [runs for runs, _ in close(alts)]


def trigram_query(pattern: str) -> list[frozenset] | None:
    """OR of ANDs of lower-case trigrams; None when some alternative has none (scan fully)."""
    alts = [frozenset(r[i:i + 3] for r in runs for i in range(len(r) - 2)) for runs in _strings(rp.parse(pattern))]
    return None if not all(alts) else list(dict.fromkeys(alts))


def postings(docs: DataFrame, id_col: str, text_col: str, grams: list[str]) -> DataFrame:
    """(gram, doc) for the trigrams that some rule needs, over the lower-cased texts."""
    low = docs.select(F.col(id_col).alias("doc"), ascii_lower(F.coalesce(text_col, F.lit(""))).alias("low"))
    hit = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    return low.select("doc", F.explode(hit).alias("gram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str) -> DataFrame:
    """(doc, kinds): the rules whose trigram query the document's postings satisfy."""
    spark = docs.sparkSession
    asked = [(r.kind, i, g, len(alt)) for r in rules for i, alt in enumerate(trigram_query(r.pattern) or []) for g in alt]
    grams = sorted({g for _, _, g, _ in asked})
    query = spark.createDataFrame(asked, "kind string, alt int, gram string, need int")   # one row per rule trigram
    met = (postings(docs, id_col, text_col, grams).distinct().join(F.broadcast(query), "gram")
           .groupBy("doc", "kind", "alt", "need").count().where("count = need"))
    return met.groupBy("doc").agg(F.collect_set("kind").alias("kinds"))   # as many kinds as rules at most


def _spans(rule: Rule, order: int, text: Column) -> Column:
    """Array of (start, order, kind, end) of the rule's matches, in code points.

    ``split`` gives what lies between the matches and ``regexp_extract_all``
    the matches themselves; their lengths, added up, are the positions.
    """
    pat = F.lit(("(?i)" if rule.any_case else "") + rule.pattern)
    lens = F.arrays_zip(
        F.transform(F.split(text, pat, -1), lambda x: F.length(x)).alias("gap"),
        F.transform(F.regexp_extract_all(text, pat, F.lit(0)), lambda x: F.length(x)).alias("size"),
        F.transform(F.regexp_extract_all(text, pat, F.lit(rule.group)), lambda x: F.length(x)).alias("part"))
    none = F.expr("array()").cast("array<struct<start:int,ord:int,kind:string,end:int,part:int>>")

    def step(acc, x):
        at = acc["at"] + x["gap"]
        span = F.struct(at.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"),
                        (at + x["size"]).alias("end"), x["part"].alias("part"))
        return F.struct((at + F.coalesce(x["size"], F.lit(0))).alias("at"),
                        F.when(x["part"] >= rule.least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    walked = F.aggregate(lens, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.regexp_like(text, pat), walked).otherwise(none)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """(id, spans): every match of every rule per row, as (start, ord, kind, end) sorted by start, then rule.

    Null texts are empty and have no spans. Repeated ids share candidates and
    are verified row by row; a null id is a value like any other. Texts are
    read whole, other columns are ignored, an empty table gives no rows.
    """
    base = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    kinds = stage(candidates(base, rules, "doc", "body")).withColumnRenamed("doc", "cdoc")
    rows = base.join(kinds, base["doc"].eqNullSafe(F.col("cdoc")), "left")
    found = []
    for i, r in enumerate(rules):
        spans = _spans(r, i, F.col("body"))
        if trigram_query(r.pattern) is not None:
            spans = F.when(F.array_contains("kinds", F.lit(r.kind)), spans)
        found.append(F.coalesce(spans, F.expr("array()").cast("array<struct<start:int,ord:int,kind:string,end:int,part:int>>")))
    return rows.select(F.col("doc").alias(id_col), F.sort_array(F.concat(*found)).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["ord"] < len(BASE))
    count = lambda i: F.size(F.filter("spans", lambda s: s["ord"] == i)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)],
                        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _sql() -> str:
    both = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    words = "|".join(map(both, ("password", "passwd", "secret", "token"))) + "|" + both("api") + "_?" + both("key")
    pats = {r.kind: (r.pattern, r.group, r.least) for r in BASE + MORE}
    pats["assign"] = ("(" + words + ")" + BASE[0].pattern.partition(")")[2], 2, 6)
    ctes, cols = [], []
    for i, (k, (p, g, least)) in enumerate(pats.items()):
        q = p.replace("'", "''")
        ctes.append(f"""{k} AS (SELECT doc_id, list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'s': list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
  'o': {i}, 'n': length(m[i]), 'p': length(part[i])}}), lambda z: z.p >= {least}) AS spans
 FROM (SELECT doc_id, string_split_regex(body, '{q}') AS gap, regexp_extract_all(body, '{q}') AS m, regexp_extract_all(body, '{q}', {g}) AS part FROM d))""")
        cols.append(k)
    names = "[" + ", ".join(f"'{k}'" for k in cols) + "]"
    text = lambda x: f"array_to_string(list_transform({x}, lambda z: {names}[z.o + 1] || ':' || CAST(z.s AS BIGINT) || ':' || CAST(z.s + z.n AS BIGINT)), ',')"
    return (f"WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents), " + ",\n".join(ctes) +
            f", u AS (SELECT {cols[0]}.doc_id, list_sort(" + " || ".join(f"{k}.spans" for k in cols) + ") AS spans FROM " +
            cols[0] + "".join(f" JOIN {k} USING (doc_id)" for k in cols[1:]) + ")\nSELECT doc_id, " +
            ", ".join(f"CAST(len(list_filter(spans, lambda z: z.o = {i})) AS BIGINT) AS n_{r.kind}" for i, r in enumerate(BASE)) +
            f", sha256({text('list_filter(spans, lambda z: z.o < 3)')}) AS base_sha256, {text('spans')} AS spans FROM u")


SQL_SECRETS = _sql()
