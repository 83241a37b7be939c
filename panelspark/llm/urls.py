"""URL filter: explicit rules, and for other urls a tree of path templates per host.

Segment by segment from a host's root to each path's end, a segment is kept if it surely has SHARE or more of the
different paths at that node of the tree (its number less Z standard errors), else it is variable and becomes a wildcard.
Shares of different paths don't change with the number of pages or with repeated ones. Paths that a rule decides are the
labels. Branches of one node (a host and all but the last segment of its templates) are merged if two rates can't be
told apart from those of their siblings (two proportions, Z standard errors): that of blocked labels, and that of paths whose
last segment begins with a digit. So a branch without labels takes the share of its siblings only if its segments are like
theirs. A template is rejected if its share of blocked labels, smoothed by SMOOTH labels at the overall rate, is PURITY or more.

The tree is settled level by level: as many rounds as the deepest node with FEWEST paths has segments.

Results for odd input: a null url, or one without "://", has an empty host and path and no rule, and is judged like any
other template without labels; a branch none of whose siblings has labels is allowed; a null page_id stays null; repeated
rows are judged alike; other columns are left aside.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import cut

#: The rules: verdict, host, path.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
SHARE = 0.05
SMOOTH, PURITY, Z = 4, 0.8, 2
#: Fewer paths can't surely have a share: n - Z * sqrt(n) is above 0 from here on.
FEWEST = Z * Z + 1


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    begin = F.locate("://", url)
    rest = F.when(begin > 0, F.substring(url, begin + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def decided(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def templates(paths: DataFrame) -> DataFrame:
    """Different paths (host, path) with node and template."""
    rows = cut(paths.select("host", "path", F.expr("slice(split(path, '/'), 2, 1 << 30)").alias("segments"), F.lit("").alias("template")))
    settled = [rows.where(F.size("segments") == 0).drop("segments")]
    rows, d = rows.where(F.size("segments") > 0), 0
    while not rows.isEmpty():
        segment = F.get("segments", F.lit(d))
        counts = cut(rows.groupBy("host", "template", segment.alias("segment")).agg(F.count("*").alias("n")))
        # below a node of fewer paths every segment is variable, however deep
        nodes = counts.groupBy("host", "template").agg(F.sum("n").alias("all")).where(F.col("all") >= FEWEST)
        sure = F.col("n") - Z * F.sqrt("n") >= SHARE * F.col("all")
        often = counts.where((F.col("segment") != "") & (F.col("n") >= FEWEST)).join(nodes, ["host", "template"]).where(sure)
        often = often.groupBy("host", "template").agg(F.collect_set("segment").alias("literals"))  # fewer than 1 / SHARE
        known = cut(nodes.join(often, ["host", "template"], "left").select("host", "template", F.coalesce("literals", F.array().cast("array<string>")).alias("literals")))
        step = F.when(F.array_contains("literals", segment), segment).otherwise(F.lit("*"))
        rest = F.concat("template", F.repeat(F.lit("/*"), F.size("segments") - d))
        longer = F.when(F.col("literals").isNull(), rest).otherwise(F.concat("template", F.lit("/"), step))
        d += 1
        done = F.col("literals").isNull() | (F.size("segments") == d)
        rows = cut(rows.join(known, ["host", "template"], "left").select("host", "path", "segments", longer.alias("template"), done.alias("done")))
        settled.append(rows.where("done").select("host", "path", "template"))
        rows = rows.where("not done").drop("done")
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out.withColumn("node", F.regexp_extract("template", "^(.*)/[^/]*$", 1))


def alike(hits: str, of: str) -> Column:
    """Whether a branch's rate of hits can't be told from that of its siblings; hits_all, of_all: of all branches of the node."""
    n, b, n_all, b_all = F.col(of), F.col(hits), F.col(f"{of}_all"), F.col(f"{hits}_all")
    n2, b2 = n_all - n, b_all - b
    p = F.when(n_all > 0, b_all / n_all).otherwise(0.0)
    gap = F.abs(b * n2 - b2 * n).cast("double")  # difference of the rates times n * n2; 0 if either has none
    return gap * gap <= Z * Z * p * (1 - p) * n * n2 * n_all


def purity(paths: DataFrame) -> DataFrame:
    """For each template whether it is rejected; paths: host, node, template, path, verdict (null without a label)."""
    digit = F.col("path").rlike("/[0-9][^/]*$").cast("long")
    bad = F.coalesce(F.sum((F.col("verdict") == "block").cast("long")), F.lit(0))
    each = cut(paths.groupBy("host", "node", "template").agg(F.count("verdict").alias("n"), bad.alias("b"), F.count("*").alias("m"), F.coalesce(F.sum(digit), F.lit(0)).alias("g")))
    siblings = each.groupBy("host", "node").agg(*(F.sum(c).alias(f"{c}_all") for c in "nbmg"))
    overall = each.agg(F.sum("b").alias("b_total"), F.sum("n").alias("n_total"))  # one row
    rows = each.join(siblings, ["host", "node"]).withColumn("alike", alike("b", "n") & alike("g", "m"))
    pooled = rows.where("alike").groupBy("host", "node").agg(F.sum("n").alias("n_like"), F.sum("b").alias("b_like"))
    rows = rows.join(pooled, ["host", "node"], "left").crossJoin(F.broadcast(overall))
    n, b = (F.when(F.col("alike"), F.col(f"{c}_like")).otherwise(F.col(c)) for c in "nb")
    rate = F.when(F.col("n_total") > 0, F.col("b_total") / F.col("n_total")).otherwise(0.0)
    share = (b + SMOOTH * rate) / (n + SMOOTH)
    return rows.select("host", "node", "template", ((n > 0) & (share >= PURITY)).alias("rejected"))


def judged(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, template of every page."""
    host, path = parts(F.col("url").cast("string"))
    urls = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = decided(F.col("host"), F.col("path"))
    paths = cut(templates(urls.select("host", "path").distinct()).withColumn("rule", rule).withColumn("verdict", verdict))
    known = cut(purity(paths))
    own = F.when(F.col("rejected"), "block").otherwise("allow")
    told = cut(paths.join(known, ["host", "node", "template"]).select("host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "template"))
    return urls.join(told, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict", "template")
