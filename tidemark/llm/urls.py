"""URL filters: host and path rules, and a path-template tree for the urls that no rule fits."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, lasting, read, scratch


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


#: The production rules (fixed values).
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MIN_ROWS = 20  # rows that a branch needs to be told apart from others, however large its node
DISTINCT = 1.96  # standard errors between the purities of a branch and of all others like it that tell it apart
BANDS = 6  # bands of purity; branches of a node in the same band are alike
ALONE = 0.95  # share of its shape's rows from which a branch names the shape, as there is nothing to merge it with
WEIGHT = 10.0  # pseudo-observations with the purity of the level above
PURITY = 0.5  # templates with less smoothed purity are rejected


def after_scheme(url: Column) -> Column:
    """What follows the first ://; empty for null and for urls without it."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*+)", 1), UPPER, LOWER)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*+([^?#]*+)", 1)


def fitting(host: Column, path: Column, rules: tuple[Rule, ...], value) -> Column:
    """value(rule) of the longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.lit(value(rule))).otherwise(found)
    return found


def shape(segment: Column) -> Column:
    """The wildcard of a segment: its kind, and its ending after a dot if it has one."""
    ending = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    stem = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    kind = (
        F.when(stem.rlike(r"^[0-9]++$"), "<number>")
        .when(stem.rlike(r"^[0-9A-Fa-f]{8,}+$"), "<hex>")
        .when(stem.rlike(r"[0-9]"), "<mixed>")
        .when(stem.rlike(r"[-_+%]"), "<words>")
        .otherwise("<word>")
    )
    return F.concat(kind, F.lower(ending))


SUMS = ("n", "known", "wrong")


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    """n rows, known of them labelled, wrong of these bad, for each key."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count("bad").alias("known"), F.coalesce(F.sum("bad"), F.lit(0)).alias("wrong"))


def _added(sums: DataFrame, *keys: str) -> DataFrame:
    return sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])


def _other(sums: DataFrame, prefix: str) -> DataFrame:
    return sums.select(*[c for c in sums.columns if c not in SUMS], *[F.col(c).alias(f"{prefix}_{c}") for c in SUMS])


def branches(segments: DataFrame) -> DataFrame:
    """segments (host, template, segment, shape, n, known, wrong) -> (host, template, segment, part): how the branches that
    don't go by the wildcard of their shape are written in the template.

    A branch of MIN_ROWS rows or more stands apart if its labelled purity differs from that of all other branches of its
    node and shape. Branches apart are compared by their purity, shrunk to their node's: those in the same band of its
    arcsine (whose spread doesn't depend on the purity) are alike and merge to one part; a single one stays literal.
    """
    node = ["host", "template"]
    kinds = _other(checkpointed(_added(segments, *node, "shape")), "all")
    nodes = _other(_added(segments, *node), "node")
    large = segments.filter(F.col("n") >= MIN_ROWS).join(kinds, [*node, "shape"]).join(nodes, node)
    known, rest = F.col("known"), F.col("all_known") - F.col("known")
    p, q = F.col("wrong") / known, (F.col("all_wrong") - F.col("wrong")) / rest
    pooled = F.col("all_wrong") / F.col("all_known")
    error = F.sqrt(pooled * (1 - pooled) * (1 / known + 1 / rest))
    differs = F.when((known > 0) & (rest > 0), F.abs(p - q) > DISTINCT * error).otherwise(False)
    named = F.col("n") >= ALONE * F.col("all_n")
    base = (F.col("node_wrong") + 1) / (F.col("node_known") + 2)
    shrunk = (F.col("wrong") + WEIGHT * base) / (known + WEIGHT)
    band = F.least(F.floor(F.asin(F.sqrt(shrunk)) * (2 / math.pi) * BANDS), F.lit(BANDS - 1))
    apart = large.filter(differs | named).select(*node, "segment", F.when(named, F.lit(-1)).otherwise(band).alias("band"))
    # a branch that names its shape is not merged with those of other shapes
    apart = checkpointed(apart.withColumn("band", F.when(F.col("band") < 0, F.concat(F.lit("="), "segment")).otherwise(F.col("band").cast("string"))))
    alike = apart.groupBy(*node, "band").agg(F.min("segment").alias("least"), F.count("*").alias("branches"))
    part = F.when(F.col("branches") == 1, F.col("segment")).otherwise(F.concat(F.lit("<like "), "least", F.lit(">")))
    return apart.join(alike, [*node, "band"]).select(*node, "segment", part.alias("part"))


def templates(rows: DataFrame) -> DataFrame:
    """rows (host, path, bad, ...) with template: the path with wildcards, from the host's tree.

    The tree grows level by level, as deep as branches can still differ: a node is open if it has MIN_ROWS rows or more
    and labels of both kinds; all below other nodes merges to the wildcards of its shapes at once. Each level is one
    aggregation by node and segment, from which all counts come, and a join with the open nodes and the branches that
    have a part of their own; these come from the checkpoint folder, so that Spark can split the rows of a host or segment
    with very many urls.
    """
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = rows.withColumns({"segments": segments, "template": F.lit("")})
    done, node, level = None, ["host", "template"], 0
    while True:
        below = F.transform(F.slice("segments", level + 1, F.greatest(F.size("segments") - level, F.lit(0))), lambda s: F.concat(F.lit("/"), shape(s)))
        closed = F.concat("template", F.array_join(below, ""))
        inner = rows.select(*node, "bad", F.get("segments", F.lit(level)).alias("segment")).filter("segment is not null")
        found = checkpointed(_sums(inner, *node, "segment").withColumn("shape", shape(F.col("segment"))))
        nodes = _added(found, *node).filter((F.col("n") >= MIN_ROWS) & (F.col("wrong") > 0) & (F.col("wrong") < F.col("known")))
        nodes = checkpointed(nodes.select(*node, F.lit(True).alias("open")))
        if nodes.isEmpty():
            last = rows.withColumn("template", closed)
            rows = last if done is None else done.unionByName(last)
            break
        parts = checkpointed(branches(found.join(nodes, node, "left_semi")))
        segment = F.get("segments", F.lit(level))
        rows = rows.withColumn("segment", segment).join(nodes, node, "left").join(parts, [*node, "segment"], "left")
        going = F.col("open").isNotNull() & F.col("segment").isNotNull()
        longer = F.concat("template", F.lit("/"), F.coalesce("part", shape(F.col("segment"))))
        rows = checkpointed(rows.withColumns({"template": F.when(going, longer).otherwise(closed), "open": going}).drop("segment", "part"))
        ended = rows.filter("not open").drop("open")
        done = ended if done is None else done.unionByName(ended)
        rows, level = rows.filter("open").drop("open"), level + 1
    slash = F.when(F.endswith("path", F.lit("/")), "/").otherwise("")
    return rows.withColumn("template", F.concat("template", slash)).drop("segments")


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity), one row per row of pages.

    labels: (id long, bad 0 or 1) of the documents that urls name by the number that ends their path. The longest
    fitting rule decides; else a url is blocked if the smoothed purity of its template is below PURITY: the share of
    labelled urls that aren't bad, shrunk to the host's, which is shrunk to the whole table's (1 without labels).
    Null and empty urls and urls without :// have an empty host and path, fit no rule, and form a template of their own.
    Of equally long rules that fit, the last by text decides. Repeated rows count each and
    get equal results; rows without page_id stay; very long urls are taken as a whole; an empty table has no rows, and
    without labels nothing is blocked but by rules. Other columns are not looked at.
    """
    with scratch(pages.sparkSession):
        return lasting(_judged(pages, labels, rules))


def _judged(pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    rest = after_scheme(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = rows.select("page_id", host_of(rest).alias("host"), path_of(rest).alias("path"))
    named = F.expr("try_cast(regexp_extract(path, '/([0-9]{1,18})([.][A-Za-z]+)?/?$', 1) as bigint)")
    known = checkpointed(labels.filter("id is not null and bad is not null").groupBy("id").agg(F.max("bad").cast("long").alias("bad")))
    rows = rows.withColumn("id", named).join(known, "id", "left").drop("id")
    rows = templates(rows)

    whole = rows.agg(F.count("bad").alias("known"), F.sum("bad").alias("wrong")).first()
    rate = whole["wrong"] / whole["known"] if whole["known"] else 0.0
    hosts = _sums(rows, "host").select(
        "host", ((F.col("wrong") + WEIGHT * F.lit(rate)) / (F.col("known") + WEIGHT)).alias("host_rate")
    )
    leaves = checkpointed(_sums(rows, "host", "template"))
    scored = leaves.join(checkpointed(hosts), "host").select(
        "host", "template", (1 - (F.col("wrong") + WEIGHT * F.col("host_rate")) / (F.col("known") + WEIGHT)).alias("purity")
    )
    judged = rows.join(checkpointed(scored), ["host", "template"])
    host, path = F.col("host"), F.col("path")
    by_method = F.when(F.col("purity") < PURITY, "block").otherwise("allow")
    return judged.select(
        "page_id",
        "host",
        "path",
        fitting(host, path, rules, lambda r: r.text).alias("rule"),
        F.coalesce(fitting(host, path, rules, lambda r: r.verdict), by_method).alias("verdict"),
        "template",
        "purity",
    )


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns for every page: page_id, host, path, rule, verdict; and template and purity. Documents of
    low quality or marked toxic count as bad."""
    labels = read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad")
    )
    return judge(read(spark, sf_dir, "pages"), labels)
