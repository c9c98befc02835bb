"""URL filter by a path-template tree.

Hosts are the roots. Level by level a path's segments become branches, digits generalised to ``0``. A branch keeps its own
segment when it has ``least_labels`` labels and its share of bad ones differs from its parent's by more than two standard
deviations; the others - rare segments and those like their parent - are merged into the parent's wildcard branch. The
tree goes down until paths end or a node has fewer than ``least_labels`` labels; what follows there is ``**``.

A node's purity is its share of bad labels, smoothed by ``prior_weight`` labels of its parent's purity, a host's by that of
its domain (the last two names) and a domain's by the rate of all labels. A template is rejected when it has
``least_labels`` labels and its purity reaches ``reject``. Rules given by hand come first: the longest that fits a url decides.

The tree is built from counts of generalised paths, not from urls, so a host with a third of all urls is pre-aggregated
before anything is shuffled.

Defined results: a null url, or one without ``://``, has an empty host and path; hosts are lower-cased in A to Z only;
equal urls get equal verdicts; without labels nothing is rejected; an empty table gives an empty table.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, maybe_broadcast

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WILD, REST = "*", "**"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):  # the longest is tested first, as the outermost
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def shape_of(path: Column) -> Column:
    """The path with digits generalised."""
    return F.regexp_replace(path, "[0-9]+", "0")


def smoothed(parent: Column, weight: float) -> Column:
    return (F.col("bad") + weight * parent) / (F.col("labelled") + weight)


def template_tree(shapes: DataFrame, least_labels: int = 5, prior_weight: float = 5.0) -> DataFrame:
    """(host, shape, template, labelled, purity) for counted shapes (host, shape, labelled, bad)."""
    total = F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")
    overall = shapes.agg(*total).select(F.coalesce(F.col("bad") / F.when(F.col("labelled") > 0, F.col("labelled")), F.lit(0.0)).alias("_rate"))
    domain = F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0)
    hosts = materialize(shapes.groupBy("host").agg(*total).withColumn("_d", domain), "hosts")
    domains = hosts.groupBy("_d").agg(*total).join(F.broadcast(overall), F.lit(True)).select(F.col("_d").alias("_domain"), smoothed(F.col("_rate"), prior_weight).alias("_prior"))  # a single row
    roots = hosts.join(domains, F.col("_d") == F.col("_domain")).select(F.col("host").alias("_h"), "labelled", smoothed(F.col("_prior"), prior_weight).alias("purity"))
    parts = F.slice(F.split("shape", "/", -1), F.lit(2), F.greatest(F.size(F.split("shape", "/", -1)) - 1, F.lit(0)))
    at = shapes.select("host", "shape", F.col("labelled").alias("_l"), F.col("bad").alias("_b"), parts.alias("parts"), F.lit("").alias("template"))
    at = materialize(at.join(roots, F.col("host") == F.col("_h")).drop("_h").withColumn("open", F.col("labelled") >= least_labels), "tree")
    level = 0
    while True:  # one pass for each level that has nodes with enough labels
        going = F.col("open") & (F.size("parts") > level)
        if at.where(going).isEmpty():
            break
        node = F.col("host").alias("_h"), F.col("template").alias("_t"), F.get("parts", F.lit(level)).alias("_s")
        branch = at.where(going).groupBy(*node).agg(
            F.sum("_l").alias("labelled"), F.sum("_b").alias("bad"), F.first("purity").alias("_parent")
        )  # the parent's purity is the same in all rows
        whole = branch.groupBy(F.col("_h").alias("_ph"), F.col("_t").alias("_pt")).agg(F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
        real = lambda c: F.col(c).cast("double")
        off = real("bad") * real("all_labelled") - real("all_bad") * real("labelled")
        differs = off * off > 4 * real("all_bad") * (real("all_labelled") - real("all_bad")) * real("labelled")
        own = (F.col("labelled") >= least_labels) & differs
        named = branch.join(whole, (F.col("_h") == F.col("_ph")) & (F.col("_t") == F.col("_pt")))
        named = materialize(named.select("_h", "_t", "_s", "labelled", "bad", "_parent", F.concat("_t", F.lit("/"), F.when(own, F.col("_s")).otherwise(WILD)).alias("_new")), "branches")
        merged = named.groupBy(F.col("_h").alias("_mh"), F.col("_new").alias("_mn")).agg(*total, F.first("_parent").alias("_parent"))
        merged = merged.select("_mh", "_mn", F.col("labelled").alias("_ml"), smoothed(F.col("_parent"), prior_weight).alias("_mp"))
        nodes = named.select("_h", "_t", "_s", "_new").join(merged, (F.col("_h") == F.col("_mh")) & (F.col("_new") == F.col("_mn"))).drop("_mh", "_mn")
        here = (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")) & (F.get("parts", F.lit(level)) == F.col("_s")) & going
        joined = at.join(nodes, here, "left")
        found = F.col("_new").isNotNull()
        at = joined.select(
            "host", "shape", "_l", "_b", "parts", F.coalesce("_new", "template").alias("template"), F.when(found, F.col("_ml")).otherwise(F.col("labelled")).alias("labelled"),
            F.when(found, F.col("_mp")).otherwise(F.col("purity")).alias("purity"), (found & (F.col("_ml") >= least_labels)).alias("open"),
        )
        level += 1
        at = materialize(at.withColumn("template", F.when(~F.col("open") & found_rest(level), F.concat("template", F.lit("/" + REST))).otherwise(F.col("template"))), "tree")
    return at.select("host", "shape", "template", "labelled", "purity")


def found_rest(level: int) -> Column:
    """Whether a path goes on below a node that is closed at ``level``, and isn't marked so yet."""
    return (F.size("parts") > level) & ~F.col("template").endswith(REST)


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[Rule], reject: float = 0.8, least_labels: int = 5) -> DataFrame:
    """``pages`` (page_id, url) with host, path, template, purity, rule and verdict. ``labels``: (page_id, bad), at most a row for each page."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    urls = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("shape", shape_of(F.col("path")))
    known = labels.select(F.col("page_id").alias("_id"), F.col("bad").cast("long").alias("bad"))
    shapes = urls.join(known, F.col("page_id") == F.col("_id"), "left").groupBy("host", "shape")
    shapes = materialize(shapes.agg(F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")), "shapes")
    tree = materialize(template_tree(shapes, least_labels), "templates")
    tree = maybe_broadcast(tree.select(F.col("host").alias("_host"), F.col("shape").alias("_shape"), "template", "labelled", "purity"), 50_000)
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rejected = (F.col("labelled") >= least_labels) & (F.col("purity") >= reject)
    out = urls.join(tree, (F.col("host") == F.col("_host")) & (F.col("shape") == F.col("_shape")), "left")
    out = out.withColumns({"rule": name, "verdict": F.coalesce(verdict, F.when(rejected, "block").otherwise("allow"))})
    return out.select("page_id", "url", "host", "path", "template", "purity", "rule", "verdict")
