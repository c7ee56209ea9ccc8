"""URL judgement by rules and by a path-template tree, with DataFrame functions only.

Rules that fit a URL decide it. The others are judged by templates learned from
the decided ones: per host, segments of digits, hexadecimals or great length
become wildcards, then, level by level, segments of a branch with very many
children; branches whose labelled block rate does not differ significantly from
their siblings' are merged into their parent's wildcard. The same tree over the
paths of all hosts tells what a path is elsewhere. A template is rejected if its
block rate, smoothed towards what its host and its path make likely, exceeds a
limit.

All statistics come from counts of (host, shape), which are combined in each
task, so a host with very many pages is no single task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismfeed.llm._tables import keep

#: Least levels of the tree, and children from which a branch's segments are variable.
LEVELS, MANY = 4, 32
#: Standard errors within which a branch is merged with its siblings, pages that the expected rate counts for, block rate of rejection.
SIMILAR, WEIGHT, REJECT = 1.96, 8.0, 0.6
#: What stands for variable, merged and deeper segments.
ANY, ALIKE, DEEPER = "*", "~", "**"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path; both empty without ://."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits. rules: (verdict, host, path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def shape(path: Column) -> Column:
    """Segments of a path, variable ones by their looks alone as wildcards (with their extension)."""
    return F.transform(
        segments(path),
        lambda s: F.when(s.rlike(r"^[0-9]+(\.[A-Za-z]{1,5})?$") | s.rlike(r"^[0-9a-f-]{16,}$") | (F.length(s) > 32), F.concat(F.lit(ANY), F.regexp_extract(s, r"^[0-9]+(\.[A-Za-z]{1,5})$", 1))).otherwise(s),
    )


def templates(counts: DataFrame, levels: int = LEVELS, many: int = MANY, similar: float = SIMILAR) -> DataFrame:
    """counts (host, shape, pages, labelled, blocked), one row for each host and shape, with the template of each.

    The tree has `levels` levels, and more while some branch holds labels of both
    kinds and deeper paths; what lies deeper is one wildcard.
    """
    tree = counts.withColumn("template", F.expr("cast(array() as array<string>)"))
    rate = lambda b, n: F.when(n > 0, b / n).otherwise(0.0)
    level = 0
    while level < levels or not tree.groupBy("host", "template").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b"), F.max(F.size("shape")).alias("deep")).filter((F.col("b") > 0) & (F.col("b") < F.col("n")) & (F.col("deep") > level)).isEmpty():
        level += 1
        seg = F.when(F.size("shape") >= level, F.element_at("shape", level))
        tree = tree.withColumn("seg", F.coalesce(seg, F.lit("")))
        child = tree.groupBy("host", "template", "seg").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b"))
        # grouped by a struct: the join has an exchange of its own on either side, so the children of one branch can be split
        branch = child.groupBy(F.struct("host", "template").alias("k")).agg(F.count_if(F.col("seg") != "").alias("children"), F.sum("n").alias("all_n"), F.sum("b").alias("all_b"))
        near = child.join(branch.select("k.host", "k.template", "children", "all_n", "all_b"), ["host", "template"])
        others_n, others_b = F.col("all_n") - F.col("n"), F.col("all_b") - F.col("b")
        pooled = rate(F.col("all_b"), F.col("all_n"))
        error = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest(F.col("n"), F.lit(1)) + 1 / F.greatest(others_n, F.lit(1))))
        apart = (F.col("n") > 0) & (others_n > 0) & (F.abs(rate(F.col("b"), F.col("n")) - rate(others_b, others_n)) > similar * error)
        known = (F.col("n") > 0) & (others_n > 0) & ~apart
        step = F.when(F.col("seg") == "", F.lit(None)).when((F.col("children") >= many) & ~apart, F.lit(ANY)).when(known, F.lit(ALIKE)).otherwise(F.col("seg"))
        named = near.select("host", "template", "seg", step.alias("step"))
        tree = tree.join(named, ["host", "template", "seg"]).withColumn("template", F.when(F.col("step").isNull(), F.col("template")).otherwise(F.concat("template", F.array("step"))))
        tree = keep(tree.drop("seg", "step"), "url-tree")  # a row for each host and shape; else every level would plan all before it several times
    rest = F.when(F.size("shape") > level, F.concat("template", F.array(F.lit(DEEPER)))).otherwise(F.col("template"))
    return tree.withColumn("template", rest)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def template_rates(counts: DataFrame, levels: int = LEVELS, weight: float = WEIGHT) -> DataFrame:
    """counts (host, shape, pages, labelled, blocked), one row for each host and shape, with template and block_rate.

    The rate is that of the template's labelled pages and `weight` more pages of
    the rate to be expected: the odds of the host times those of the path's
    template over all hosts, both smoothed towards even odds. So a host without
    labels is judged by what its paths are elsewhere, a path without labels by its
    host, and without either nothing is rejected.
    """
    smooth = lambda b, n, towards: (F.col(b) + weight * towards) / (F.col(n) + weight)
    labels = [F.sum(c).alias(c) for c in ("labelled", "blocked")]
    rates = lambda df, keys, name: df.groupBy(*keys).agg(*labels).select(*keys, smooth("blocked", "labelled", 0.5).alias(name))
    paths = templates(counts.groupBy(F.lit("").alias("host"), "shape").agg(*labels), levels).select("shape", F.col("template").alias("path"), "labelled", "blocked")
    of_path = keep(paths.select("shape", "path").join(rates(paths, ["path"], "path_rate"), "path").select("shape", "path_rate"), "url-paths")
    tree = templates(counts, levels)
    own = tree.groupBy("host", "template").agg(F.sum("labelled").alias("tn"), F.sum("blocked").alias("tb"))
    each = tree.join(own, ["host", "template"]).join(rates(counts, ["host"], "host_rate"), "host").join(of_path, "shape")
    expected = 1 / (1 + F.exp(-(_logit(F.col("host_rate")) + _logit(F.col("path_rate")))))
    return each.select("host", "shape", "template", smooth("tb", "tn", expected).alias("block_rate"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", weight: float = WEIGHT, reject: float = REJECT) -> DataFrame:
    """Rows (id, host, path, rule, verdict, template, block_rate) for every row of pages; verdict is the rule's, else the method's.

    A null URL, or one without ://, has an empty host and path and an empty
    template. Without any label all rates are one half and nothing is rejected.
    Repeated rows and rows of a null id are counted and judged each; a very long
    path is one template like any other; an empty table gives an empty result;
    rules of equal length that fit one URL can't differ in host and path; other
    columns are not read.
    """
    parsed = pages.select(F.col(id_col), F.col(url_col).alias("url"))
    host, path = url_parts(F.col("url"))
    parsed = parsed.select(id_col, host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(rules)
    ruled = parsed.select(id_col, "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    judged = ruled.withColumn("shape", shape(F.col("path")))
    labelled, blocked = F.count("ruled"), F.count_if(F.col("ruled") == "block")
    counts = keep(judged.groupBy("host", "shape").agg(F.count("*").alias("pages"), labelled.alias("labelled"), blocked.alias("blocked")), "url-counts")
    known = keep(template_rates(counts, weight=weight), "url-rates")
    method = F.when(F.col("block_rate") > reject, "block").otherwise("allow")
    out = judged.join(known, ["host", "shape"], "left")
    return out.select(id_col, "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "block_rate")
