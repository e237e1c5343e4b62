"""URL filters: rules by host and path, and a path-template tree where no rule fits.

Tree: a path's segments become a template per host. Segments that look like numbers, hashes or dates are
wildcards at once; a literal segment is one too when its parent branch has many different children and
the segment holds a small share of them. Branches whose labelled share of blocked urls is close to their
host's (two-sided z below ``merge_z``) are merged with it and use its counts. A template is rejected when
its purity, the smoothed share of blocked urls, exceeds ``max_purity``. Smoothing adds ``alpha`` urls of
the next level's purity: template, host, templates of the same form on all hosts, and at last one half. Urls
that a rule judges are the labelled ones, unless the caller passes labels.

With ``siblings`` branches are not compared with their host but with each other: of one parent's labelled
branches, in the order of their blocked share, each is merged with those before it unless a two-sample test
tells them apart. A template's purity is smoothed along its branches from the host down. A template without
labels is unknown: it has the purity of its form on all hosts, smoothed towards all labelled urls.

Null urls and urls without ``://`` have empty host and path, fit no rule and fall to the tree, where they
share one template. Repeated rows are judged alike. Every step is a grouped count or an equi-join whose
rows are combined first, so a host with a third of all urls is summed in parts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.llm.common import whole

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
VARIABLE = r"^(?:[0-9][0-9._-]*|[0-9a-fA-F]{16,}|[0-9a-fA-F-]{32,36})(\.[A-Za-z]{2,5})?$"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path."""
    url = whole(url)
    return F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.regexp_extract(url, URL, 2)


def rule_name(rule: tuple[str, str, str]) -> str:
    return rule[1] + rule[2]


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or null; ``rules`` are (verdict, host, path).

    Of equally long rules the one with the longer host wins, then block before allow.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(rule_name(r)), len(r[1]), r[0] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def templates(paths: DataFrame, max_children: int = 8, max_share: float = 0.05) -> DataFrame:
    """``host, path, template, form`` of distinct ``host, path, n``, where ``n`` counts the urls.

    ``form`` is the template without its host. The parent of a segment is its prefix after look-alike
    segments have become wildcards.
    """
    looks = F.transform(_segments(F.col("path")), lambda s: F.regexp_replace(s, VARIABLE, "*$1"))
    segs = paths.select("host", "path", "n", F.posexplode_outer(looks).alias("level", "seg"), looks.alias("looks"))
    segs = segs.select("host", "path", "n", "level", "seg", F.xxhash64(F.slice("looks", 1, F.col("level"))).alias("parent"))
    child = segs.where("seg is not null").groupBy("host", "parent", "level", "seg").agg(F.sum("n").alias("n_seg"))
    parent = child.groupBy("host", "parent", "level").agg(F.count("*").alias("children"), F.sum("n_seg").alias("n_parent"))
    wild = child.join(parent, ["host", "parent", "level"]).select(
        "host", "parent", "level", "seg",
        ((F.col("children") > max_children) & (F.col("n_seg") < max_share * F.col("n_parent"))).alias("wild"))
    marked = segs.join(wild, ["host", "parent", "level", "seg"], "left").select(
        "host", "path", "level", F.when(F.col("wild"), F.lit("*")).otherwise(F.col("seg")).alias("seg"))
    whole_path = marked.groupBy("host", "path").agg(F.sort_array(F.collect_list(F.struct("level", "seg"))).alias("segs"))
    form = F.concat(F.lit("/"), F.concat_ws("/", F.transform("segs", lambda s: s["seg"])))
    return whole_path.select("host", "path", form.alias("form")).withColumn("template", F.concat("host", "form"))


def template_purity(labelled: DataFrame, alpha: float = 4.0, merge_z: float = 1.96) -> DataFrame:
    """``host, form, purity, merged`` of every template from rows ``host, form, n, blocked, allowed``."""
    counts = ("blocked", "allowed")
    by = labelled.groupBy("host", "form").agg(*[F.sum(c).alias(c) for c in counts])
    forms = by.groupBy("form").agg(*[F.sum(c).alias(f"form_{c}") for c in counts])
    hosts = by.groupBy("host").agg(*[F.sum(c).alias(f"host_{c}") for c in counts])
    rows = by.join(hosts, "host").join(forms, "form")

    def smooth(level: str, prior: Column) -> Column:
        b, a = F.col(f"{level}blocked"), F.col(f"{level}allowed")
        return (b + alpha * prior) / (b + a + alpha)

    rows = rows.withColumn("p_form", smooth("form_", F.lit(0.5))).withColumn("p_host", smooth("host_", F.col("p_form")))
    n, n_host = F.col("blocked") + F.col("allowed"), F.col("host_blocked") + F.col("host_allowed")
    pooled = F.col("host_blocked") / n_host
    gap = F.abs(F.col("blocked") / n - pooled) / F.sqrt(pooled * (1 - pooled) / n)
    similar = F.when(n == 0, True).when((pooled == 0) | (pooled == 1), True).otherwise(gap < merge_z)
    merged = F.coalesce(similar, F.lit(True))
    return rows.select(
        "host", "form", F.when(merged, F.col("p_host")).otherwise(smooth("", F.col("p_host"))).alias("purity"), merged.alias("merged"))


def alike(a: tuple[int, int], b: tuple[int, int], merge_z: float) -> bool:
    """Two-sample test of (blocked, allowed) counts."""
    m, n = sum(a), sum(b)
    pooled = (a[0] + b[0]) / (m + n)
    return abs(a[0] / m - b[0] / n) < merge_z * math.sqrt(pooled * (1 - pooled) * (1 / m + 1 / n)) or pooled in (0, 1)


def merge_siblings(branches: list, merge_z: float) -> list[tuple[str, bool, int, int, bool]]:
    """``(node, leaf, blocked, allowed, merged)`` with the counts of what each labelled branch is merged with."""
    groups: list[tuple[list, int, int]] = []
    for node, leaf, b, a in sorted(branches, key=lambda x: (x[2] / (x[2] + x[3]), x[0], x[1])):
        if groups and alike(groups[-1][1:], (b, a), merge_z):
            members, gb, ga = groups[-1]
            groups[-1] = ([*members, (node, leaf)], gb + b, ga + a)
        else:
            groups.append(([(node, leaf)], b, a))
    return [(*m, b, a, len(members) > 1) for members, b, a in groups for m in members]


def sibling_purity(labelled: DataFrame, alpha: float = 4.0, merge_z: float = 1.96) -> DataFrame:
    """As ``template_purity``, with branches merged among siblings and unlabelled ones unknown."""
    by = labelled.groupBy("host", "form").agg(F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"))

    def smooth(b: Column, a: Column, prior: Column) -> Column:
        return (b + alpha * prior) / (b + a + alpha)

    total = by.agg(F.sum("blocked").alias("all_b"), F.sum("allowed").alias("all_a")).select(
        smooth(F.coalesce("all_b", F.lit(0)), F.coalesce("all_a", F.lit(0)), F.lit(0.5)).alias("p_all"))
    forms = by.groupBy("form").agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a")).crossJoin(F.broadcast(total))
    forms = forms.select("form", smooth(F.col("b"), F.col("a"), F.col("p_all")).alias("p_form"))
    hosts = by.groupBy("host").agg(F.sum("blocked").alias("host_b"), F.sum("allowed").alias("host_a"))
    segs = F.split(F.expr("substring(form, 2)"), "/")
    prefix = lambda k: F.concat(F.lit("/"), F.array_join(F.slice(segs, 1, k), "/"))
    steps = F.transform(F.sequence(F.lit(1), F.size(segs)), lambda k: F.struct(
        k.alias("level"), prefix(k).alias("node"), (k == F.size(segs)).alias("leaf"), F.when(k > 1, prefix(k - 1)).otherwise("").alias("parent")))
    steps = by.where("blocked + allowed > 0").select("host", "form", "blocked", "allowed", F.explode(steps).alias("s")).select("host", "form", "blocked", "allowed", "s.*")
    nodes = steps.groupBy("host", "parent", "node", "leaf").agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a"))
    kind = "array<struct<node:string,leaf:boolean,b:long,a:long,merged:boolean>>"
    # few literal branches of one parent are left by templates(), so the list is short
    siblings = nodes.groupBy("host", "parent").agg(F.collect_list(F.struct("node", "leaf", "b", "a")).alias("x"))
    groups = siblings.select("host", F.explode(F.udf(lambda x: merge_siblings(x, merge_z), kind)("x")).alias("g")).select("host", "g.*")
    path = steps.join(groups, ["host", "node", "leaf"]).groupBy("host", "form").agg(
        F.sort_array(F.collect_list(F.struct("level", "b", "a", "merged"))).alias("path"))
    rows = by.join(forms, "form").join(hosts, "host").join(path, ["host", "form"], "left")
    start = smooth(F.col("host_b"), F.col("host_a"), F.col("p_form"))
    purity = F.aggregate("path", start, lambda p, g: smooth(g["b"], g["a"], p))
    merged = F.exists("path", lambda g: g["merged"])
    return rows.select("host", "form", F.coalesce(purity, "p_form").alias("purity"), F.coalesce(merged, F.lit(False)).alias("merged"))


def judge(
    pages: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url", label: Column | None = None,
    max_purity: float = 0.5, alpha: float = 4.0, merge_z: float = 1.96, max_children: int = 8, max_share: float = 0.05,
    siblings: bool = False,
) -> DataFrame:
    """Verdict of every row: its rule's, else the template's.

    ``label`` (1 blocked, 0 allowed, null unknown) replaces the rules' verdicts as training labels.
    """
    host, path = split_url(F.col(url))
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"), *([label.alias("label")] if label is not None else []))
    hit = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("hit", hit)
    known = F.col("label") == 1 if label is not None else F.col("hit.verdict") == "block"
    paths = rows.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count_if(known).alias("blocked"), F.count_if(~known).alias("allowed"))
    trees = templates(paths, max_children, max_share)
    labelled = trees.join(paths, ["host", "path"])
    purity = (sibling_purity if siblings else template_purity)(labelled, alpha, merge_z)
    verdicts = trees.join(purity, ["host", "form"]).select("host", "path", "template", "purity", "merged")
    judged = rows.join(verdicts, ["host", "path"])
    return judged.select(
        F.col("key").alias(key), "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), F.when(F.col("purity") > max_purity, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "template", "purity", F.col("merged").alias("merged_branch"))
