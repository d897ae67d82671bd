"""URL verdicts: rules first, else a tree of path templates per host.

Urls are first counted by host and path shape (digits and long codes in a segment stand for a
class), which leaves far fewer rows than urls. The tree grows one level at a time on that table:
where a node has too many different segments, they become one wildcard; of the others, those
whose share of good labels does not differ from their siblings' are merged into one branch. A
template is rejected when its purity, the share of good labels smoothed towards the share of
all, is too low. Nothing is held for a host but counts, so large hosts are spread like any key.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritlake.llm.frames import written


class Rule(NamedTuple):
    """``site`` is host and path as one text; the host ends before the first slash."""

    verdict: str
    site: str


MOST_CHILDREN = 24       # more different segments below a node are one wildcard
SIMILAR = 2.58           # standard errors within which a branch is like its siblings
STRENGTH = 20.0          # labels that the share of all counts for in a template's purity
LEAST_PURITY = 0.5
WILD, MERGED = "*", "~"


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty without ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct(site, verdict); null if none does."""
    fitting = [F.lit(None).cast("struct<site: string, verdict: string>")]
    for rule in sorted(rules, key=lambda r: (-len(r.site), r.site)):
        name, slash, rest = rule.site.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        fitting.append(F.when(fits, F.struct(F.lit(rule.site).alias("site"), F.lit(rule.verdict).alias("verdict"))))
    return F.coalesce(*fitting)


def path_shape(path: Column) -> Column:
    """The path's segments; numbers and long codes become classes, the rest stays."""
    shaped = F.regexp_replace(path, r"(?<![^/])[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![^/.])", "<uuid>")
    shaped = F.regexp_replace(shaped, r"(?<![^/])(?=[^/.]*[0-9])(?=[^/.]*[a-fA-F])[0-9a-fA-F]{12,}(?![^/.])", "<code>")
    shaped = F.regexp_replace(shaped, r"[0-9]+", "<n>")
    return F.filter(F.split(shaped, "/"), lambda s: s != "")


def _shared(low: Column, high: Column) -> Column:
    """Number of segments that two shapes share from their start; of a node's least and greatest shape, what all its shapes share."""
    return F.aggregate(F.zip_with(low, high, lambda a, b: a.eqNullSafe(b)), F.struct(F.lit(0).alias("n"), F.lit(True).alias("same")),
                       lambda so, same: F.struct((so["n"] + (so["same"] & same).cast("int")).alias("n"), (so["same"] & same).alias("same")),
                       lambda so: so["n"])


def grow_templates(shapes: DataFrame, most_children: int = MOST_CHILDREN, similar: float = SIMILAR) -> DataFrame:
    """host, shape, template, n, labelled, good from host, shape (segments), n, labelled, good; a row for each shape of a host."""
    growing = written(shapes.withColumn("template", F.lit("")).withColumn("rest", F.col("shape")), "url-shapes")
    grown: list[DataFrame] = []
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "good")]
    while not growing.isEmpty():
        ends = growing.groupBy("host", "template").agg(F.min("rest").alias("low"), F.max("rest").alias("high"))
        passed = F.slice("rest", F.lit(1), F.col("shared"))
        at = growing.join(ends.select("host", "template", _shared(F.col("low"), F.col("high")).alias("shared")), ["host", "template"]).select(
            *[c for c in growing.columns if c not in ("template", "rest")],
            F.concat("template", F.when(F.col("shared") > 0, F.concat(F.lit("/"), F.array_join(passed, "/"))).otherwise("")).alias("template"),
            F.slice("rest", F.col("shared") + 1, F.greatest(F.size("rest") - F.col("shared"), F.lit(0))).alias("rest")).withColumn(
            "segment", F.get("rest", F.lit(0)))
        branches = at.filter("segment IS NOT NULL").groupBy("host", "template", "segment").agg(*sums)
        nodes = branches.groupBy("host", "template").agg(
            F.count("*").alias("children"), F.sum("labelled").alias("all_labelled"), F.sum("good").alias("all_good"))
        # share of the branch against that of its siblings, in standard errors of the difference
        others = F.col("all_labelled") - F.col("labelled")
        pooled = F.try_divide("all_good", "all_labelled")
        error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), F.col("labelled")) + F.try_divide(F.lit(1.0), others)))
        apart = F.abs(F.try_divide("good", "labelled") - F.try_divide(F.col("all_good") - F.col("good"), others))
        differs = (error > 0) & (apart > similar * error)  # null without labels on both sides
        name = (F.when(F.coalesce(differs, F.lit(False)), F.col("segment"))
                .when(F.col("children") > most_children, F.lit(WILD))
                .when(F.col("children") > 1, F.lit(MERGED)).otherwise(F.col("segment")))
        named = branches.join(nodes, ["host", "template"]).select("host", "template", "segment", name.alias("name"))
        level = written(
            at.join(named, ["host", "template", "segment"], "left").withColumns({
                "template": F.when(F.col("name").isNotNull(), F.concat("template", F.lit("/"), "name")).otherwise(F.col("template")),
                "rest": F.slice("rest", F.lit(2), F.greatest(F.size("rest") - 1, F.lit(0)))}).drop("segment", "name"),
            f"url-level-{len(grown)}")
        # a shape that ends beside longer ones stays where it is
        grown.append(level.filter(F.size("rest") == 0).drop("rest"))
        growing = level.filter(F.size("rest") > 0)
    return reduce(DataFrame.unionByName, grown, growing.drop("rest"))


def judge_urls(urls: DataFrame, labels: DataFrame, rules: list[Rule], url: str = "url", key: str = "page_id",
               least_purity: float = LEAST_PURITY, strength: float = STRENGTH, **tree) -> DataFrame:
    """key, host, path, rule, verdict and template of every row.

    ``labels`` has a key and a label (1 good, 0 bad; others are left out); a row's labels are those
    of its key, several are averaged. Rows with a null key have none; urls that are null or lack
    :// have an empty host and path and are judged by their template like all. A template without
    labels has the purity of all labels; without any label all are allowed. Rows, repeated or not,
    are each judged; other columns are not kept.
    """
    marks = labels.filter("label IN (0, 1)").groupBy("key").agg(
        F.count("*").alias("marks"), F.avg("label").alias("share"))
    rows = urls.select(urls[key].alias("key"), urls[url].alias("url"))
    rows = rows.withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    rows = rows.withColumn("shape", path_shape(F.col("path")))
    shapes = (rows.join(marks, "key", "left").groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count("share").alias("labelled"), F.coalesce(F.sum("share"), F.lit(0.0)).alias("good")))
    grown = grow_templates(shapes, **tree)
    share = grown.agg(F.try_divide(F.sum("good"), F.sum("labelled")).alias("share")).first()["share"]  # one row
    purity = (F.col("good") + strength * F.col("share")) / (F.col("labelled") + strength)
    templates = grown.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
    rejected = templates.withColumn("share", F.lit(share).cast("double")).filter(purity < least_purity)
    verdicts = grown.select("host", "shape", "template").join(
        rejected.select("host", "template", F.lit("block").alias("found")), ["host", "template"], "left")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    return (rows.join(verdicts, ["host", "shape"], "left").withColumn("__rule", rule).select(
        F.col("key").alias(key), "host", "path", F.col("__rule.site").alias("rule"),
        F.coalesce("__rule.verdict", "found", F.lit("allow")).alias("verdict"), "template"))
