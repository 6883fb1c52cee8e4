"""URL filter: fixed host and path rules, then a path-template tree judged by
labels.

Template tree: the segments of a path are nodes below their host.  A segment
with digits is variable at once and becomes ``*`` (its extension stays); a
node most of whose pages lead to different children gets ``*`` for them.  The
labelled pages of a template are counted; sibling templates whose share of
bad pages does not differ significantly from that of their parent's other
templates (two-proportion z test) are merged into one branch.  A branch is
rejected if its share of bad pages, smoothed towards the share of all
labelled pages, is above a limit.

All statistics are partial aggregates over (host, template) and cover all
pages, so a host with a third of them is many small partial counts.  Defined
results: a null URL, or one without ``://``, has empty host and path, fits no
rule and is judged as the template of the empty host; repeated rows are
judged one by one; without labels nothing is rejected by the method; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import ascii_lower

# Fixed values: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

# A node with more different children than this, most of them on few pages,
# has a variable segment there.
BRANCHES = 32
# Weight, in pages, of the overall share in the smoothed share of a branch.
SMOOTHING = 4.0
MAX_BAD_SHARE = 0.5
Z_SIMILAR = 1.96


def host_and_path(url: Column) -> tuple[Column, Column]:
    none = F.lit("")
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), none), F.coalesce(path, none)


def matched_rule(rules: Sequence[tuple[str, str, str]], host: Column, path: Column):
    """``(rule, verdict)`` of the longest rule that fits; of equally long ones
    the first in alphabetical order."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # the shortest is nested innermost, so the longest is asked first
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def shape(path: Column) -> Column:
    """The path with every segment that holds a digit as ``*``, keeping a
    digit-free extension."""
    return F.regexp_replace(path, r"[^/]*[0-9][^/.]*", "*")


def templates(paths: DataFrame) -> DataFrame:
    """``(host, shape, template, parent)`` of the distinct (host, shape)
    pairs of ``paths(host, shape)``, high-cardinality segments as ``*``."""
    counted = paths.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("pages"))
    segments = F.split("shape", "/", -1)
    nodes = counted.select("host", "shape", "pages", F.posexplode(segments).alias("i", "segment"))
    nodes = nodes.withColumn("above", F.call_function("substring_index", F.col("shape"), F.lit("/"), F.col("i")))
    children = nodes.groupBy("host", "above", "i", "segment").agg(F.sum("pages").alias("pages"))
    wild = children.groupBy("host", "above", "i").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pages").alias("pages")
    )
    wild = wild.where((F.col("n") > BRANCHES) & (2 * F.col("n") > F.col("pages")))
    wild = wild.select("host", "above", "i", F.lit(True).alias("wild"))
    named = nodes.join(wild, ["host", "above", "i"], "left").select(
        "host", "shape", "i", F.when(F.col("wild"), "*").otherwise(F.col("segment")).alias("segment")
    )
    # one row per segment of one path
    built = named.groupBy("host", "shape").agg(
        F.array_sort(F.collect_list(F.struct("i", "segment"))).alias("parts")
    )
    built = built.withColumn("parts", F.col("parts.segment"))
    return built.select(
        "host", "shape", F.array_join("parts", "/").alias("template"),
        F.array_join(F.slice("parts", 1, F.size("parts") - 1), "/").alias("parent"),
    )


def branches(counts: DataFrame) -> DataFrame:
    """``(host, template, branch, n, bad)``: labelled counts of the branch
    that each template of ``counts(host, template, parent, n, bad)`` ends in."""
    parents = counts.groupBy("host", "parent").agg(
        F.sum("n").alias("pn"), F.sum("bad").alias("pbad")
    )
    both = counts.join(parents, ["host", "parent"])
    rest_n, rest_bad = F.col("pn") - F.col("n"), F.col("pbad") - F.col("bad")
    share = F.try_divide("pbad", "pn")
    each = F.try_divide(F.lit(1.0), F.col("n")) + F.try_divide(F.lit(1.0), rest_n)
    gap = F.abs(F.try_divide("bad", "n") - F.try_divide(rest_bad, rest_n))
    # null where one of the two sides has no labelled page
    alike = (F.col("n") == 0) | (gap <= Z_SIMILAR * F.sqrt(share * (1 - share) * each))
    both = both.withColumn(
        "branch",
        F.when(F.coalesce(alike, F.lit(False)), F.concat("parent", F.lit("/~"))).otherwise(
            F.col("template")
        ),
    )
    merged = both.groupBy("host", "branch").agg(F.sum("n").alias("bn"), F.sum("bad").alias("bbad"))
    return both.join(merged, ["host", "branch"]).select(
        "host", "template", "branch", F.col("bn").alias("n"), F.col("bbad").alias("bad")
    )


def url_verdicts(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    url_col: str = "url",
    id_col: str = "page_id",
) -> DataFrame:
    """``(id, host, path, template, branch, rule, verdict)`` of every page;
    ``labels(id, bad)`` has the known pages, one row each."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = rows.select("id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("shape", shape(F.col("path")))
    tree = templates(rows)

    known = rows.join(labels.select("id", "bad"), "id").groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("bad")).alias("bad")
    )
    known = tree.join(known, ["host", "shape"], "left").groupBy("host", "template", "parent").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    total = known.agg(F.coalesce(F.try_divide(F.sum("bad"), F.sum("n")), F.lit(0.0)).alias("share"))
    smoothed = (F.col("bad") + SMOOTHING * F.col("share")) / (F.col("n") + SMOOTHING)
    judged = branches(known).join(F.broadcast(total)).select(
        "host", "template", "branch", (smoothed > MAX_BAD_SHARE).alias("rejected")
    )
    by_shape = tree.join(judged, ["host", "template"]).select(
        "host", "shape", "template", "branch", "rejected"
    )
    rule, ruled = matched_rule(rules, F.col("host"), F.col("path"))
    own = F.when(F.col("rejected"), "block").otherwise("allow")
    return rows.join(by_shape, ["host", "shape"]).select(
        "id", "host", "path", "template", "branch",
        rule.alias("rule"), F.coalesce(ruled, own).alias("verdict"),
    )
