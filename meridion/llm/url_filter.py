"""URL filtering: longest matching rule, else a path-template tree learned from the urls that a rule decides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridion.llm.common import materialise

#: (verdict, host, path) of the query's rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A segment of these shapes is a variable at once: numbers, long hexadecimal strings, either with a file ending.
VARIABLE = r"^(\d+|[0-9a-fA-F]{8,}|[0-9a-fA-F-]{32,})(\.[A-Za-z0-9]{1,5})?$"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def matched_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """A struct ``(rule, verdict)`` of the longest rule that fits, or null. One expression: the rules are a literal list."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    tests = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    found = [F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for v, h, p in ordered]
    return F.coalesce(*[F.when(t, s) for t, s in zip(tests, found, strict=True)]) if rules else F.lit(None).cast("struct<rule:string,verdict:string>")


def path_templates(urls: DataFrame, depth: int = 4, children: int = 32, support: float = 3.0, z: float = 1.96, prior: float = 8.0) -> DataFrame:
    """The tree of path templates of ``urls(host, path, label)``, label 1 blocked, 0 allowed, null unknown.

    Returns ``(host, level, template, n, blocked, labelled, purity)`` with a row per node. A node's template joins the
    first ``level`` segments by ``/``. Each level is a few sums over ``(host, parent)``; no host is gathered anywhere:

    1. a segment of a variable shape is ``*``; so is every child of a parent with more than ``children`` different
       children that hold fewer than ``support`` urls each on average;
    2. of the children left, those with labels whose share of blocked urls differs from that of their labelled siblings
       together by less than ``z`` standard errors (of the pooled share, with one blocked and one allowed url added, so that
       it is never 0 or 1) are merged into one branch ``+``, as statistically the same; children without labels stay apart;
    3. purity is ``(blocked + prior * p) / (labelled + prior)`` with p the parent's purity, at a host's root the share of
       blocked urls over the whole table. A node that holds none or all of its parent's labels adds nothing to them and has
       its parent's purity.

    Segments beyond ``depth`` are one variable tail ``**``, so the tree's height doesn't grow with the urls.
    """
    return _grown(urls, depth, children, support, z, prior)[1].drop("share", "decided_by")


def _grown(urls: DataFrame, depth: int, children: int, support: float, z: float, prior: float) -> tuple[DataFrame, DataFrame]:
    """The leaves, and the nodes with ``share`` (blocked labels among all, of the nearest node upwards that has any; else null)
    and ``decided_by`` (that node's template)."""
    parts = F.split(F.regexp_replace(F.coalesce("path", F.lit("")), "^/", ""), "/")
    segs = F.slice(parts, 1, depth)
    segs = F.when(F.size(parts) > depth, F.concat(segs, F.array(F.lit("**")))).otherwise(segs)
    shaped = F.transform(segs, lambda s: F.when(s.rlike(VARIABLE), F.lit("*")).otherwise(s))
    # From here on there is one row for each host and list of shaped segments, not for each url.
    rows = urls.select("host", shaped.alias("segs"), "label").groupBy("host", "segs").agg(
        F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked")
    )
    # Each level reads the one above twice; kept in the shared folder, it is computed once.
    rows = materialise(rows.withColumn("node", F.lit("")))
    overall = urls.agg((F.coalesce(F.sum("label"), F.lit(0)) / F.greatest(F.count("label"), F.lit(1))).alias("p")).first()["p"]
    sums = [F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")]
    own = F.when(F.col("labelled") > 0, F.col("blocked") / F.greatest("labelled", F.lit(1)))
    root = rows.groupBy("host").agg(*sums).select("host", F.lit(0).alias("level"), F.lit("").alias("template"), "n", "labelled", "blocked")
    purity = (F.col("blocked") + F.lit(prior * overall)) / (F.col("labelled") + F.lit(prior))
    mine = F.when(F.col("labelled") > 0, F.col("template"))
    levels = [materialise(root.withColumn("purity", purity).withColumn("share", own).withColumn("decided_by", mine))]
    for level in range(1, depth + 2):
        seg = F.get("segs", F.lit(level - 1))
        child = rows.where(F.size("segs") >= level).groupBy("host", F.col("node").alias("parent"), seg.alias("seg")).agg(*sums)
        stats = child.groupBy("host", "parent").agg(
            F.count("*").alias("kids"), F.sum("n").alias("pn"), F.sum("labelled").alias("pl"), F.sum("blocked").alias("pb")
        )
        others = F.col("pl") - F.col("labelled")
        pooled = (F.col("pb") + 1) / (F.col("pl") + 2)
        error = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest("labelled", F.lit(1)) + 1 / F.greatest(others, F.lit(1))))
        apart = F.abs(F.col("blocked") / F.greatest("labelled", F.lit(1)) - (F.col("pb") - F.col("blocked")) / F.greatest(others, F.lit(1)))
        alike = (F.col("labelled") > 0) & (others > 0) & (apart <= z * error)
        wide = (F.col("kids") > children) & (F.col("pn") / F.col("kids") < support)
        named = child.join(stats, ["host", "parent"]).withColumn(
            "name", F.when(F.col("seg").isin("*", "**"), F.col("seg")).when(wide, F.lit("*")).when(alike & (F.col("kids") > 1), F.lit("+")).otherwise(F.col("seg"))
        )
        names = named.select(F.col("host").alias("h"), "parent", F.col("seg").alias("s"), F.concat_ws("/", F.when(F.col("parent") != "", F.col("parent")), "name").alias("to"))
        joined = rows.join(names, (F.col("host") == F.col("h")) & (F.col("node") == F.col("parent")) & (seg == F.col("s")), "left")
        rows = materialise(joined.select("host", "segs", "n", "labelled", "blocked", F.coalesce("to", "node").alias("node"), F.col("node").alias("above")))
        nodes = rows.where(F.size("segs") >= level).groupBy("host", "node", "above").agg(*sums)
        up = levels[-1].select("host", F.col("template").alias("above"), F.col("labelled").alias("ul"), F.col("purity").alias("up"), F.col("share").alias("us"), F.col("decided_by").alias("ud"))
        purity = F.when((F.col("labelled") == 0) | (F.col("labelled") == F.col("ul")), F.col("up")).otherwise((F.col("blocked") + prior * F.col("up")) / (F.col("labelled") + F.lit(prior)))
        levels.append(materialise(nodes.join(up, ["host", "above"]).select(
            "host", F.lit(level).alias("level"), F.col("node").alias("template"), "n", "labelled", "blocked", purity.alias("purity"), F.coalesce(own, "us").alias("share"),
            F.coalesce(F.when(F.col("labelled") > 0, F.col("node")), F.col("ud")).alias("decided_by"),
        )))
    nodes = reduce(DataFrame.unionByName, levels)
    return rows.select("host", "segs", F.col("node").alias("template"), F.size("segs").alias("level")), nodes


def judge_urls(df: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, reject_at: float = 0.8, depth: int = 4, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(id, host, path, rule, verdict, template, purity, decided_by)`` for every url.

    A rule's verdict is final. Other urls fall to the deepest template of their path; a template is rejected where its
    smoothed purity of blocked urls and the plain share among the labels of the nearest node upwards that has any, itself
    first (``decided_by``), are both at least ``reject_at``. Any other is allowed, so a host without labels is, whatever the rest of the table.
    The labels that the tree learns from are the urls that a rule decides. A null url, or one without ``://``, has an empty
    host and path and is allowed, as is all of a table without labels. Very long urls are read whole; their path counts to
    ``depth`` segments, what follows is one tail. Repeated rows are judged alike and all kept; null ids stay null; an empty
    table gives an empty result. Other columns are not read, so their names can't clash.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = df.select(F.col(id_col).alias("__id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("hit", matched_rule(F.col("host"), F.col("path"), rules))
    label = F.when(F.col("hit.verdict") == "block", 1).when(F.col("hit.verdict") == "allow", 0)
    leaves, nodes = _grown(rows.select("host", "path", label.alias("label")), depth, 32, 3.0, 1.96, 8.0)
    judged = leaves.join(nodes.select("host", "level", "template", "purity", "share", "decided_by"), ["host", "level", "template"]).select(
        F.col("host").alias("h"), F.col("segs").alias("s"), "template", "purity", "share", "decided_by"
    )
    parts = F.split(F.regexp_replace("path", "^/", ""), "/")
    segs = F.slice(parts, 1, depth)
    segs = F.when(F.size(parts) > depth, F.concat(segs, F.array(F.lit("**")))).otherwise(segs)
    rows = rows.withColumn("segs", F.transform(segs, lambda s: F.when(s.rlike(VARIABLE), F.lit("*")).otherwise(s)))
    found = rows.join(judged, (F.col("host") == F.col("h")) & (F.col("segs") == F.col("s")), "left")
    verdict = F.coalesce(F.col("hit.verdict"), F.when((F.least("purity", "share") >= reject_at) & F.col("share").isNotNull() & (F.col("host") != ""), F.lit("block")).otherwise(F.lit("allow")))
    return found.select(F.col("__id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "template", "purity", "decided_by")
