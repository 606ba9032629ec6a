"""URL filtering by path templates.

Every host has a tree of path segments.  From the root down, the children of a
node become one wildcard where they vary: where they look like ids, or where
there are many distinct ones for the visits.  From the leaves up, sibling
branches whose labelled shares of bad pages do not differ by more than
chance are merged into a wildcard branch.  A template is rejected where its
smoothed share of good labelled pages is too low.  Fixed rules go first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Segments that name one thing: numbers, long hex strings, UUIDs and dates, with an extension or not.
_ID = r"^(?:\d+|[0-9a-f]{8,}|[0-9a-f]{8}-[0-9a-f-]{27}|\d{4}-\d{2}-\d{2})(?:\.\w{1,5})?$"


def split_url(url):
    """``(host, path)`` columns of a URL column; both empty without ``://`` or for null."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(rules: list[tuple[str, str, str]], host, path):
    """``(rule, verdict)`` of the longest fitting rule ``(verdict, host, path)``; null where none fits."""
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


#: Parts of a host's rows in a join with something small per host, so that no host is joined in one task.
_SALTS = 16


def _salted(rows: DataFrame, small: DataFrame, keys: list[str], spread: str, how: str = "inner") -> DataFrame:
    """Join on ``keys``, null-free, where one of ``rows``'s keys may hold most rows: ``small`` meets each of its parts."""
    left = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(_SALTS)).cast("int"))
    right = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return left.join(right, [*keys, "salt"], how).drop("salt")


def templates(pages: DataFrame, least_distinct: int = 16, least_share: float = 0.5) -> DataFrame:
    """``(host, path, segs, n, labelled, bad, tmpl)`` per distinct host and path of ``pages(host, path, bad)``.

    ``tmpl`` has as many entries as ``segs``: a segment or ``*``. A path goes down the tree as long as another one shares its node; from
    there on it has nothing to vary against and keeps its segments, but for those that look like ids. What all paths of a node share is
    passed in one step, so the rounds are as many as the branchings on one path, not as its segments.
    """
    per = pages.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad"))
    now = per.withColumn("segs", F.filter(F.split("path", "/"), lambda s: s != "")).withColumn("tmpl", F.array().cast("array<string>"))
    now, done = materialize(now, "paths"), []
    plain = lambda s: F.when(s.rlike(_ID), "*").otherwise(s)
    while True:
        # the segments that all paths of a node begin with from here on
        left = F.slice("segs", F.size("tmpl") + 1, F.greatest(F.size("segs") - F.size("tmpl"), F.lit(0)))
        ends = now.groupBy("host", "tmpl").agg(F.min(left).alias("lo"), F.max(left).alias("hi"), F.count(F.lit(1)).alias("members"))
        least = F.least(F.size("lo"), F.size("hi"))
        unlike = F.filter(F.when(least > 0, F.sequence(F.lit(0), least - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.get("lo", i) != F.get("hi", i))
        ends = ends.select("host", "tmpl", F.when(F.col("members") > 1, F.coalesce(F.array_min(unlike), least)).otherwise(0).alias("shared"))
        passed = F.transform(F.slice("segs", F.size("tmpl") + 1, F.col("shared")), plain)
        now = _salted(now, ends, ["host", "tmpl"], "path").withColumn("tmpl", F.concat("tmpl", passed)).drop("shared")
        seg = F.get("segs", F.size("tmpl"))
        step = now.withColumn("seg", F.when(seg.rlike(_ID), "*").otherwise(seg))
        kids = step.where("seg is not null").groupBy("host", "tmpl", "seg").agg(F.sum(F.when(F.col("seg") != "*", F.col("n"))).alias("n"), F.count(F.lit(1)).alias("paths"))
        nodes = kids.groupBy("host", "tmpl").agg(F.count("n").alias("kinds"), F.sum("n").alias("visits"), F.sum("paths").alias("paths"))
        nodes = nodes.select("host", "tmpl", (F.coalesce((F.col("kinds") >= least_distinct) & (F.col("kinds") >= least_share * F.col("visits")), F.lit(False))).alias("wild"), (F.col("paths") == 1).alias("alone"))
        met = _salted(step, nodes, ["host", "tmpl"], "path", "left")
        rest = F.transform(left, plain)
        ends = F.col("seg").isNull() | F.col("alone")
        met = met.withColumn("tmpl", F.when(F.col("seg").isNull(), F.col("tmpl")).when(F.col("alone"), F.concat("tmpl", rest)).otherwise(F.concat("tmpl", F.array(F.when(F.col("wild"), "*").otherwise(F.col("seg"))))))
        met = materialize(met.withColumn("ends", ends).select(*now.columns, "ends"), "paths")  # each level reads the last one twice
        done.append(met.where("ends").drop("ends"))
        now = met.where("not ends").drop("ends")
        if now.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _next_depth(now: DataFrame, below: int) -> int | None:
    """The deepest place under ``below`` in which branches of a host differ and are else the same.

    Branches without one place are told apart by the combined hashes of their places; two that only seem the same cost a round and change nothing.
    """
    place = lambda i, s: F.xxhash64(i, s)
    whole = F.aggregate(F.transform("merged", lambda s, i: place(i, s)), F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(h))
    each = now.select("host", "merged").distinct().select("host", F.size("merged").alias("size"), whole.alias("whole"), F.posexplode("merged").alias("d", "s"))
    same = each.where(F.col("d") < below).groupBy("host", "size", "d", F.col("whole").bitwiseXOR(place(F.col("d"), F.col("s"))).alias("rest")).agg(F.count(F.lit(1)).alias("n"))
    return same.where("n > 1").agg(F.max("d")).first()[0]


def merge_similar(leaves: DataFrame, z: float = 1.96) -> DataFrame:
    """``(host, tmpl, merged, labelled, bad)``: the branch that each template ends up in, with its labels.

    At every depth, deepest first, the branches that differ only there are held against all of them together: a
    branch joins the wildcard branch if its share of bad labels is within ``z`` standard errors, or if it has none. Depths at which no branches of a host
    differ only there take no round.
    """
    now = leaves.groupBy("host", "tmpl").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).withColumn("merged", F.col("tmpl"))
    now = materialize(now, "branches")
    d = 1 << 30
    while (d := _next_depth(now, d)) is not None:
        wild = F.transform("merged", lambda s, i: F.when(i == d, "*").otherwise(s))
        deep = now.where(F.size("merged") > d)
        branch = deep.groupBy("host", wild.alias("wild"), "merged").agg(F.sum("labelled").alias("b_labelled"), F.sum("bad").alias("b_bad"))
        pool = branch.groupBy("host", "wild").agg(F.sum("b_labelled").alias("p_labelled"), F.sum("b_bad").alias("p_bad"), F.count(F.lit(1)).alias("branches"))
        share = (F.col("p_bad") + 1) / (F.col("p_labelled") + 2)
        close = (F.col("b_labelled") == 0) | (F.abs(F.col("b_bad") / F.col("b_labelled") - share) <= z * F.sqrt(share * (1 - share) / F.col("b_labelled")))
        to = F.when(close & (F.col("branches") > 1), F.col("wild")).otherwise(F.col("merged"))
        met = _salted(branch, pool, ["host", "wild"], "merged").select("host", "merged", to.alias("to"))
        now = _salted(now, met, ["host", "merged"], "tmpl", "left").withColumn("merged", F.coalesce("to", "merged")).drop("to")
        now = materialize(now, "branches")
    sums = now.groupBy("host", "merged").agg(F.sum("labelled").alias("s_labelled"), F.sum("bad").alias("s_bad"))
    return _salted(now, sums, ["host", "merged"], "tmpl").select("host", "tmpl", "merged", F.col("s_labelled").alias("labelled"), F.col("s_bad").alias("bad"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = (), id_col: str = "page_id", url_col: str = "url", least_purity: float = 0.5, prior: float = 4.0) -> DataFrame:
    """``(page_id, host, path, rule, template, purity, verdict)`` for every row.

    labels: ``(page_id, bad)``; pages without one, or with null, count as unlabelled, and of several the worst counts. The
    verdict is the longest fitting rule's, else ``block`` where the template's share of good labels, smoothed by
    ``prior`` pages of the overall share, is under ``least_purity``. Null and broken URLs form a template of their own on the
    empty host. Rows that repeat are judged alike; an empty table gives no rows; URLs of any length are split whole; other columns are ignored.
    """
    host, path = split_url(F.col(url_col))
    marks = labels.where("bad is not null and page_id is not null").groupBy(F.col("page_id").alias("l_id")).agg(F.max(F.col("bad").cast("int")).alias("bad"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).join(marks, F.col("page_id") == F.col("l_id"), "left").drop("l_id")
    rows = materialize(rows, "urls")
    leaves = materialize(templates(rows.select("host", "path", "bad")), "templates")
    merged = merge_similar(leaves)
    overall = rows.agg(F.coalesce(1 - F.avg("bad"), F.lit(1.0))).first()[0]
    good = F.col("labelled") - F.col("bad")
    judged = materialize(merged.select("host", "tmpl", "merged", ((good + prior * overall) / (F.col("labelled") + prior)).alias("purity")), "judged")
    parts = F.pmod(F.xxhash64("page_id"), F.lit(_SALTS)).cast("int")  # a front page, or all broken URLs, may be most rows
    by_path = _salted(leaves.select("host", "path", "tmpl"), judged, ["host", "tmpl"], "path").select("host", "path", F.concat(F.col("host"), F.lit("/"), F.array_join("merged", "/")).alias("template"), "purity")
    rule, fixed = rule_columns(list(rules), F.col("host"), F.col("path"))
    by_path = by_path.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    out = rows.withColumn("salt", parts).join(by_path, ["host", "path", "salt"]).drop("salt").withColumn("rule", rule).withColumn("fixed", fixed)
    own = F.when(F.col("purity") < least_purity, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", "template", "purity", F.coalesce("fixed", own).alias("verdict"))
