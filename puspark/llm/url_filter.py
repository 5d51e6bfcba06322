"""URL filters: rules first, then a tree of path templates per host, rejected by the purity of their labelled pages.

A path is a list of segments. Segments with digits or of great length are variable by their shape; a segment is also
variable where its parent has many different children and none prevails, at any depth. From the leaves up, branches
whose subtrees do not differ statistically from their parent's as a whole are merged. Pages that a rule judges are the labels: a template's
share of blocked pages, smoothed by its host's and that by the share over all hosts, decides on the pages without a
rule. All steps are aggregates and joins on templates; pages are grouped once and joined once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from puspark.sources.shared import materialise

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
MANY_CHILDREN = 16
PREVAILS = 0.5
LONG_SEGMENT = 24
#: Pages that a parent's share counts as in its children's.
PRIOR = 4.0
REJECT = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def shapes_of(path: Column) -> Column:
    """Segments of the path, variable ones by their shape."""

    def shape(s: Column) -> Column:
        return (
            F.when(s.rlike("^[0-9]+$"), "{n}")
            .when(s.rlike(r"^[0-9]+\.[a-z]+$"), F.regexp_replace(s, "^[0-9]+", "{n}"))
            .when(s.rlike("[0-9]"), "{x}")
            .when(F.length(s) > LONG_SEGMENT, "{long}")
            .otherwise(s)
        )

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), shape)


def _after(t: str, n: Column | int) -> Column:
    """The array's items after the first ``n``."""
    return F.slice(t, F.lit(n) + 1, F.greatest(F.size(t) - n, F.lit(0)))


def _starred(tree: DataFrame, level: int, marked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``tree`` with a wildcard at ``level`` where (host, parent[, child]) is in ``marked``."""
    renamed = marked.select(*[F.col(k).alias(f"_{k}") for k in keys], F.lit(True).alias("_star"))
    own = {"host": F.col("host"), "parent": F.slice("t", 1, level), "child": F.get("t", F.lit(level))}
    at = F.size("t") > level
    for k in keys:
        at = at & (own[k] == F.col(f"_{k}"))
    general = F.concat(F.slice("t", 1, level), F.array(F.lit("*")), _after("t", level + 1))
    return tree.join(renamed, at, "left").withColumn("t", F.when(F.col("_star"), general).otherwise(F.col("t"))).drop("_star", *[f"_{k}" for k in keys])


def _children(tree: DataFrame, level: int) -> DataFrame:
    """(host, parent, child, rest, n) of rows deeper than ``level``."""
    rows = tree.filter(F.size("t") > level).select("host", F.slice("t", 1, level).alias("parent"), F.get("t", F.lit(level)).alias("child"), _after("t", level + 1).alias("rest"), "n")
    return rows.groupBy("host", "parent", "child", "rest").agg(F.sum("n").alias("n"))


def templates(pages: DataFrame) -> DataFrame:
    """(host, segments, template, n, n_allow, n_block) from ``pages`` (host, segments, label).

    Every level of the longest path is gone through twice: from the host down for parents with many different children,
    and from the leaves up for similar ones. There are as many passes as levels, each over the deeper templates only.
    """
    groups = pages.groupBy("host", "segments").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "allow").alias("n_allow"), F.count_if(F.col("label") == "block").alias("n_block")
    )
    tree = materialise(groups.withColumn("t", F.col("segments")))
    deepest = tree.agg(F.max(F.size("t"))).first()[0] or 0
    for level in range(deepest):
        children = _children(tree, level).groupBy("host", "parent", "child").agg(F.sum("n").alias("n"))
        sums = children.groupBy("host", "parent").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("most"), F.sum("n").alias("whole"))
        wide = sums.filter((F.col("c") > MANY_CHILDREN) & (F.col("most") < PREVAILS * F.col("whole")))
        tree = _starred(tree, level, wide, ("host", "parent"))
        if level % 4 == 3:
            tree = materialise(tree)
    tree = materialise(tree)
    for level in range(deepest - 1, -1, -1):
        tree = _starred(tree, level, _alike(_children(tree, level), level), ("host", "parent", "child"))
        if level % 4 == 0:
            tree = materialise(tree)
    template = F.when(F.size("t") > 0, F.col("t")).otherwise(F.array(F.lit("")))
    return tree.select("host", "segments", template.alias("template"), "n", "n_allow", "n_block")


def _alike(cells: DataFrame, level: int) -> DataFrame:
    """(host, parent, child) whose rests do not differ from those of all the parent's children, by chi-square distance.

    Below the host, an only child and children without different rests are left to the shape of their own segment: there
    is nothing to tell by.
    """
    up = ["host", "parent"]
    rests = cells.groupBy(*up, "rest").agg(F.sum("n").alias("n_rest"))
    parents = rests.groupBy(*up).agg(F.sum("n_rest").alias("n_all"), F.count(F.lit(1)).alias("n_rests"))
    q = F.sum(F.col("n") * F.col("n") / F.col("n_rest")).alias("q")
    branches = cells.join(rests, [*up, "rest"]).groupBy(*up, "child").agg(F.sum("n").alias("n"), q)
    counts = branches.groupBy(*up).agg(F.count(F.lit(1)).alias("c"))
    branches = branches.join(parents, up).join(counts, up)
    if level:
        branches = branches.filter((F.col("c") > 1) & (F.col("n_rests") > 1))
    distance = F.col("n_all") * F.col("q") / F.col("n") - F.col("n")
    free = F.col("n_rests") - 1
    return branches.filter(distance <= free + 2 * F.sqrt(2.0 * free)).select(*up, "child")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url).

    A rule's verdict stands. Other pages are blocked if their template's smoothed share of blocked pages is above one
    half. Null urls and those without ``://`` have an empty host and path and are judged as one template; null ids and
    repeated rows are judged like others, each row counting once. An empty table gives an empty result.
    """
    host, path = F.col("host"), F.col("path")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumns({"found": rule_of(host, path, rules), "segments": shapes_of(path)})
    tree = materialise(templates(rows.select("host", "segments", F.col("found.verdict").alias("label"))))
    all_ = tree.agg(F.sum("n_allow"), F.sum("n_block")).first()
    share = ((all_[1] or 0) + 1.0) / ((all_[0] or 0) + (all_[1] or 0) + 2.0)

    def smoothed(above: Column) -> Column:
        return (F.sum("n_block") + PRIOR * above) / (F.sum("n_allow") + F.sum("n_block") + PRIOR)

    hosts = tree.groupBy("host").agg(smoothed(F.lit(share)).alias("above"))
    pure = tree.groupBy("host", "template").agg(F.sum("n_allow").alias("n_allow"), F.sum("n_block").alias("n_block")).join(hosts, "host")
    pure = pure.select("host", "template", ((F.col("n_block") + PRIOR * F.col("above")) / (F.col("n_allow") + F.col("n_block") + PRIOR)).alias("blocked"))
    verdicts = tree.join(pure, ["host", "template"]).select("host", "segments", F.when(F.col("blocked") > REJECT, "block").otherwise("allow").alias("judged"))
    out = rows.join(materialise(verdicts), ["host", "segments"])
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", "judged").alias("verdict"))
