"""URL filtering: explicit host/path rules, then a path-template tree.

The tree is built per host. Segments that look like identifiers become ``*``
at once; among siblings, those whose share of rejected labelled pages does not
differ significantly from that of all of them, or that have no labels, are
merged into the branch ``*``. A template is rejected when its labelled purity, smoothed towards its
host's and the host's towards the whole table's, reaches a threshold. Neither
the number of children nor the depth of a path changes how it is judged.
Paths, nodes and templates are joined by 64-bit hashes.

Labels are the explicit rules' verdicts unless the caller gives others.
Pages are first aggregated to distinct (host, generalised path) rows with
counts, so a host with a third of all pages shrinks before any shuffle, and
no group is ever gathered in one task.

Defined cases: a null url or one without ``://`` has empty host and path and
the verdict of the (empty host, empty path) template; repeated rows are
judged one by one and each counts; ties between equally long rules go to the
alphabetically first; an empty table gives no rows; extra columns stay out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from sellerlens.llm.work import add_unique, cut

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Identifier-like segments: digits, dates, hexadecimal, UUIDs, with or without
# a file ending; these become "*" whatever their number.
VARIABLE = r"^([0-9]+([-_.][0-9]+)*|[0-9a-fA-F]{8,}|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})(\.[A-Za-z0-9]{1,5})?$"


@dataclass(frozen=True)
class UrlRule:
    verdict: str  # allow or block
    host: str     # fits this host and its subdomains
    path: str     # fits urls whose path starts with it

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class TreeParams:
    rounds: int = 3            # decisions on the names of all levels, each on the last one's names
    z: float = 1.96            # branches differing by less are merged
    prior: float = 4.0         # labelled pages the host's purity counts for
    threshold: float = 0.5     # rejected share at which a template is rejected


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, shape, 1), UPPER, LOWER), F.regexp_extract(u, shape, 2)


def match_rules(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null without one."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        rule = F.when(fits, F.lit(r.text)).otherwise(rule)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def _shape(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(F.rlike(s, F.lit(VARIABLE)), F.lit("*")).otherwise(s))


def _names(segs: DataFrame, p: TreeParams) -> DataFrame:
    """``segs`` (sid, host, d, seg, labelled, bad, name) with new names: one
    decision for every child of every node of all levels, a node being the
    host and the present names before the segment."""
    before = Window.partitionBy("sid").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    # The names before as one number, in one pass over the path.
    node = F.coalesce(F.bit_xor(F.xxhash64("d", "name")).over(before), F.lit(0))
    here = segs.select("sid", "host", "d", "seg", "labelled", "bad", F.xxhash64("host", "d", node).alias("node"))
    here = cut(here.withColumn("kid", F.xxhash64("node", "seg")), "segments")
    kids = here.groupBy("node", "kid").agg(F.min("seg").alias("seg"), F.sum("labelled").alias("labelled"),
                                           F.sum("bad").alias("bad"), F.count("*").alias("c"))
    nodes = kids.groupBy("node").agg(F.count("*").alias("children"), F.sum("labelled").alias("all_labelled"),
                                     F.sum("bad").alias("all_bad"))
    rate = F.col("all_bad") / F.greatest("all_labelled", F.lit(1))
    own = F.col("bad") / F.greatest("labelled", F.lit(1))
    spread = F.sqrt(F.greatest(rate * (1 - rate), F.lit(1e-9)) / F.greatest("labelled", F.lit(1)))
    similar = (F.col("labelled") == 0) | (F.abs(own - rate) <= p.z * spread)
    name = F.when((F.col("seg") == "*") | ((F.col("children") > 1) & similar), F.lit("*")).otherwise(F.col("seg"))
    many = cut(nodes, "nodes").withColumnRenamed("children", "node_children")
    named = add_unique(cut(kids, "kids"), many, "node", "node_children").withColumnRenamed("node_children", "children")
    named = cut(named.select("kid", name.alias("name"), "c"), "names")
    return cut(add_unique(here, named, "kid", "c").drop("node", "kid", "c"), "tree")


def build_tree(shapes: DataFrame, p: TreeParams) -> DataFrame:
    """From rows (sid, host, shape, labelled, bad) to the same with ``template``.

    Whether a segment keeps its name is decided by the pages that agree in the
    names before it. Names before a segment may become wildcards, which pools
    the pages of several nodes, so the decision of all levels is taken
    ``rounds`` times, each with the names of the last one: names that rest on
    fewer than ``rounds`` changes before them are those of a tree built level
    by level. The number of jobs depends on neither depth nor width.
    """
    segs = shapes.select("sid", "host", "labelled", "bad", F.posexplode("shape").alias("d", "seg"))
    segs = segs.withColumn("name", F.col("seg"))
    for _ in range(p.rounds):
        segs = _names(segs, p)
    # A group is one path's segments.
    path = F.array_sort(F.collect_list(F.struct("d", "name")))
    names = segs.groupBy("sid").agg(F.concat(F.lit("/"), F.array_join(F.transform(path, lambda x: x["name"]), "/")).alias("template"))
    return cut(shapes.join(names, "sid", "left").withColumn("template", F.coalesce("template", F.lit(""))), "templates")


def judge(pages: DataFrame, rules, labels: DataFrame | None = None, params: TreeParams = TreeParams()) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every page.

    ``labels`` (page_id, bad as 0/1) replaces the rules' verdicts as labels.
    """
    host, path = split_url(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    p = p.select("*", rule.alias("rule"), verdict.alias("ruled"), _shape(F.col("path")).alias("shape"))
    if labels is None:
        marked = p.withColumn("bad", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0))
    else:
        given = labels.groupBy("page_id").agg(F.max("bad").alias("bad"))
        marked = p.join(given, "page_id", "left")
    shapes = marked.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count("bad").alias("labelled"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    shapes = cut(shapes.withColumn("sid", F.xxhash64("host", F.array_join("shape", "/"))), "shapes")
    tree = build_tree(shapes, params).withColumn("tid", F.xxhash64("host", "template"))
    whole = shapes.agg(((F.sum("bad") + 1) / (F.sum("labelled") + 2)).alias("overall"))
    hosts = shapes.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("bad").alias("host_bad"),
                                       F.count("*").alias("host_c"))
    sums = tree.groupBy("tid").agg(F.min("host").alias("host"), F.sum("labelled").alias("labelled"),
                                   F.sum("bad").alias("bad"), F.count("*").alias("c"))
    overall = whole.first()[0]
    k = params.prior
    host_rate = (F.col("host_bad") + k * F.lit(0.5 if overall is None else overall)) / (F.col("host_labelled") + k)
    rated = add_unique(cut(sums, "sums"), cut(hosts, "hosts"), "host", "host_c")
    purity = cut(rated.select("tid", "c", ((F.col("bad") + k * host_rate) / (F.col("labelled") + k)).alias("purity")), "purity")
    branch = cut(add_unique(tree.select("sid", "tid", "template", "n"), purity, "tid", "c").drop("tid", "c"), "branches")
    judged = add_unique(p.withColumn("sid", F.xxhash64("host", F.array_join("shape", "/"))), branch, "sid", "n")
    return judged.select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("purity") >= params.threshold, "block").otherwise("allow")).alias("verdict"),
        "template", "purity")
