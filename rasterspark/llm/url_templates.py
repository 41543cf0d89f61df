"""URL filter by path-template trees (operator 6), in DataFrame functions only.

Rules give labels: a URL that a rule fits is labelled bad (block) or good (allow).
The other URLs are judged by the template they fall under. For each host a tree of
path segments is built, as deep as its paths. Digits are generalised first, so a
segment starts as its shape. Level by level, below each template:

* a segment that is rare among many different ones is variable: wildcard ``*``;
* the remaining branches are compared with all branches of their parent taken
  together; those whose next segments are spread alike (half the sum of absolute
  differences of shares at most SIMILAR) merge into one branch ``~``, and those of
  them that have labels into ``~+``, so that no label spreads to unlike rules.

Below a template with one path left nothing can be generalised; its rest is kept as it is.

A template's badness is its share of bad labels, smoothed: PRIOR virtual pages and the
pages without a label count with the host's share, which is smoothed in the same way
with the share BASE. So a template is rejected, above REJECT, if labels of about half of
its pages say so, and one without labels only on a host that is bad in about half of all
its pages.

All steps work on counts of distinct (host, shape path), so a host with a third of
all pages is aggregated before any shuffle. Nothing is compared pair by pair.

Defined results: a null URL, or one without ``://``, has empty host and path, fits
no rule and is judged like the rest of host ''; repeated rows get equal verdicts;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterspark.llm.common import table, written

#: (action, rule); a rule is a host, then a path that begins with a slash.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
RARE_SHARE = 0.02
RARE_DISTINCT = 8
SIMILAR = 0.25
PRIOR = 4.0
BASE = 0.2
REJECT = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: str | Column) -> tuple[Column, Column]:
    """Host and path, as defined for the filter; both empty without ``://``."""
    c = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    rest = F.regexp_extract(c, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its action; both null where none does."""
    found = action = F.lit(None).cast("string")
    for act, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found, action = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(act)).otherwise(action)
    return found, action


def shape(path: Column) -> Column:
    """The path with digits as ``#``."""
    return F.regexp_replace(F.regexp_replace(path, "^/", ""), "[0-9]+", "#")


def _wildcards(tree: DataFrame, level: int) -> DataFrame:
    """Column ``branch``: the segment of this level, ``*`` where it is variable, null where there is none."""
    seg = F.get("segs", F.lit(level))
    counted = written(tree.where(seg.isNotNull()).groupBy("host", "t", seg.alias("seg")).agg(F.sum("n").alias("sn")))
    below = counted.groupBy("host", "t").agg(F.sum("sn").alias("tn"), F.count(F.lit(1)).alias("distinct"))
    rare = (F.col("distinct") >= RARE_DISTINCT) & (F.col("sn") < F.lit(RARE_SHARE) * F.col("tn"))
    branch = counted.join(below, ["host", "t"]).select("host", "t", "seg", F.when(rare, F.lit("*")).otherwise(F.col("seg")).alias("branch"))
    return tree.withColumn("seg", seg).join(branch, ["host", "t", "seg"], "left").drop("seg")


def _merged(tree: DataFrame, level: int) -> DataFrame:
    """Column ``t`` extended by the branch; branches of a parent that spread like all of them together become ``~``."""
    follow = F.coalesce(F.get("segs", F.lit(level + 1)), F.lit(""))
    spread = written(
        tree.where(F.col("branch").isNotNull()).groupBy("host", "t", "branch", follow.alias("next")).agg(F.sum("n").cast("double").alias("n"), F.sum("labelled").alias("labelled"))
    )
    whole = spread.groupBy("host", "t", "next").agg(F.sum("n").alias("wn"))
    size = spread.groupBy("host", "t", "branch").agg(F.sum("n").alias("bn"), F.sum("labelled").alias("bl"))
    total = size.groupBy("host", "t").agg(F.sum("bn").alias("tn"), F.count(F.lit(1)).alias("branches"))
    # Half the sum of |share here - share in all| is 1 - the sum of the smaller shares, so absent segments need no row.
    both = F.sum(F.least(F.col("n") * F.col("tn"), F.col("wn") * F.col("bn")))
    shared = (
        spread.join(whole, ["host", "t", "next"]).join(total, ["host", "t"]).join(size, ["host", "t", "branch"])
        .groupBy("host", "t", "branch").agg(both.alias("both"), F.max("bn").alias("bn"), F.max("tn").alias("tn"), F.max("branches").alias("branches"), F.max("bl").alias("bl"))
    )
    alike = shared.select(
        "host", "t", "branch", ((F.col("branches") > 1) & (F.col("both") >= F.lit(1 - SIMILAR) * F.col("bn") * F.col("tn"))).alias("alike"), (F.col("bl") > 0).alias("ruled")
    )
    joined = tree.join(alike, ["host", "t", "branch"], "left")
    step = F.when(F.col("alike"), F.when(F.col("ruled"), F.lit("~+")).otherwise(F.lit("~"))).otherwise(F.col("branch"))
    return joined.withColumn("t", F.when(F.col("branch").isNull(), F.col("t")).otherwise(F.concat("t", F.lit("/"), step))).drop("branch", "alike", "ruled")


def _smoothed(bad: str, labelled: str, pages: str, share: Column) -> Column:
    """Share of bad pages, where virtual pages and those without a label have ``share``."""
    return (F.col(bad) + share * (F.lit(PRIOR) + F.col(pages) - F.col(labelled))) / (F.col(pages) + F.lit(PRIOR))


def templates(pages: DataFrame) -> DataFrame:
    """(host, shape, template, badness) for every distinct host and shape path.

    ``pages`` has host, shape (the segments joined by slashes) and bad (1, 0 or null).
    """
    tree = written(pages.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad")
    ).withColumns({"segs": F.split("shape", "/"), "t": F.lit("")}))
    level = 0
    # A template below which one path is left stays as it is; the others have a level more.
    while not tree.where(F.size("segs") > level).groupBy("host", "t").count().where("count > 1").isEmpty():
        tree = written(_merged(written(_wildcards(tree, level)), level))
        level += 1
    rest = F.when(F.size("segs") > level, F.concat("t", F.lit("/"), F.array_join(F.slice("segs", F.lit(level + 1), F.size("segs")), "/")))
    tree = tree.withColumn("t", F.coalesce(rest, "t"))
    leaf = tree.groupBy("host", "t").agg(F.sum("labelled").alias("tl"), F.sum("bad").alias("tb"), F.sum("n").alias("tn"))
    by_host = leaf.groupBy("host").agg(F.sum("tl").alias("hl"), F.sum("tb").alias("hb"), F.sum("tn").alias("hn"))
    known = by_host.select("host", _smoothed("hb", "hl", "hn", F.lit(BASE)).alias("h"))
    badness = leaf.join(known, "host").select("host", "t", _smoothed("tb", "tl", "tn", F.col("h")).alias("badness"))
    return tree.select("host", "shape", "t").join(badness, ["host", "t"]).select("host", "shape", F.col("t").alias("template"), "badness")


def filter_urls(pages: DataFrame, url: str = "url", rules: tuple = RULES) -> DataFrame:
    """``pages`` with host, path, rule, template, badness and verdict added (or replaced)."""
    added = ("host", "path", "rule", "verdict", "template", "badness", "_action", "_shape")
    host, path = url_parts(url)
    pages = pages.withColumns({"_u_host": host, "_u_path": path}).drop(*added).withColumnsRenamed({"_u_host": "host", "_u_path": "path"})
    rule, action = match_rule(F.col("host"), F.col("path"), rules)
    pages = pages.withColumns({"rule": rule, "_action": action, "_shape": shape(F.col("path"))})
    bad = (F.col("_action") == "block").cast("long")
    tree = templates(pages.select("host", F.col("_shape").alias("shape"), bad.alias("bad")))
    judged = pages.join(tree.withColumnRenamed("shape", "_shape"), ["host", "_shape"])
    own = F.when(F.col("badness") > REJECT, F.lit("block")).otherwise(F.lit("allow"))
    return judged.withColumn("verdict", F.coalesce("_action", own)).drop("_action", "_shape")


def op6_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", F.round("badness", 9).alias("badness"))


def _level_sql(level: int) -> str:
    """The two steps of one level: m<level> has the tree after it."""
    prev = "m0" if level == 0 else f"m{level}"
    here, after = level + 1, level + 2
    return f"""
c{here} AS (SELECT host, t, segs[{here}] AS seg, sum(n) AS sn FROM {prev} WHERE segs[{here}] IS NOT NULL GROUP BY ALL),
r{here} AS (SELECT host, t, seg, CASE WHEN count(*) OVER (PARTITION BY host, t) >= {RARE_DISTINCT}
    AND sn < {RARE_SHARE} * sum(sn) OVER (PARTITION BY host, t) THEN '*' ELSE seg END AS branch FROM c{here}),
b{here} AS (SELECT p.*, r.branch FROM {prev} p LEFT JOIN r{here} r ON p.host = r.host AND p.t = r.t AND p.segs[{here}] = r.seg),
s{here} AS (SELECT host, t, branch, coalesce(segs[{after}], '') AS nx, sum(n) AS n, sum(labelled) AS labelled FROM b{here} WHERE branch IS NOT NULL GROUP BY ALL),
q{here} AS (SELECT host, t, branch, n, sum(n) OVER (PARTITION BY host, t, nx) AS wn, sum(n) OVER (PARTITION BY host, t, branch) AS bn,
    sum(n) OVER (PARTITION BY host, t) AS tn, sum(labelled) OVER (PARTITION BY host, t, branch) AS bl FROM s{here}),
k{here} AS (SELECT host, t, count(DISTINCT branch) AS branches FROM s{here} GROUP BY ALL),
a{here} AS (SELECT q.host, q.t, q.branch, max(k.branches) > 1 AND sum(least(n * tn, wn * bn)) >= {1 - SIMILAR} * max(bn) * max(tn) AS alike, max(bl) > 0 AS ruled
    FROM q{here} q JOIN k{here} k ON q.host = k.host AND q.t = k.t GROUP BY ALL),
m{here} AS (SELECT b.host, b.shape, b.n, b.labelled, b.bad, b.segs,
    CASE WHEN b.branch IS NULL THEN b.t ELSE b.t || '/' || CASE WHEN a.alike AND a.ruled THEN '~+' WHEN a.alike THEN '~' ELSE b.branch END END AS t
    FROM b{here} b LEFT JOIN a{here} a ON b.host = a.host AND b.t = a.t AND b.branch = a.branch)"""


def _rule_sql(column: int) -> str:
    out = "NULL"
    for rule in sorted(RULES, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule[1].partition("/")
        fits = f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash + rest}')"
        out = f"CASE WHEN {fits} THEN '{rule[column]}' ELSE {out} END"
    return out


#: Levels of the SQL twin; paths with more segments than this must differ before them.
_DEPTH = 8

ORACLE = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
g AS (SELECT *, {_rule_sql(1)} AS rule, {_rule_sql(0)} AS action,
    string_split(regexp_replace(regexp_replace(path, '^/', ''), '[0-9]+', '#', 'g'), '/') AS segs FROM h),
w AS (SELECT * FROM g),
m0 AS (SELECT host, array_to_string(segs, '/') AS shape, count(*) AS n, count(action) AS labelled, count(*) FILTER (action = 'block') AS bad, any_value(segs) AS segs, '' AS t
    FROM w GROUP BY 1, 2),
{",".join(_level_sql(i) for i in range(_DEPTH))},
mx AS (SELECT * EXCLUDE t, t || CASE WHEN len(segs) > {_DEPTH} THEN '/' || array_to_string(segs[{_DEPTH + 1}:], '/') ELSE '' END AS t FROM m{_DEPTH}),
leaf AS (SELECT host, t, sum(labelled) AS tl, sum(bad) AS tb, sum(n) AS tn FROM mx GROUP BY ALL),
hosts AS (SELECT host, sum(tl) AS hl, sum(tb) AS hb, sum(tn) AS hn FROM leaf GROUP BY ALL),
known AS (SELECT host, (hb + {BASE} * ({PRIOR} + hn - hl)) / (hn + {PRIOR}) AS h FROM hosts),
judged AS (SELECT l.host, l.t, (l.tb + k.h * ({PRIOR} + l.tn - l.tl)) / (l.tn + {PRIOR}) AS badness FROM leaf l JOIN known k ON l.host = k.host)
SELECT w.page_id, w.host, w.path, w.rule, coalesce(w.action, CASE WHEN j.badness > {REJECT} THEN 'block' ELSE 'allow' END) AS verdict,
    m.t AS template, round(j.badness, 9) AS badness
FROM w JOIN mx m ON w.host = m.host AND array_to_string(w.segs, '/') = m.shape JOIN judged j ON m.host = j.host AND m.t = j.t
"""
