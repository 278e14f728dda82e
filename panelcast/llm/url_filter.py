"""URL filter: declared rules first, then a path-template tree for every host.

Declared rules fit a host with all its subdomains and a path prefix; the longest wins.  What they
judge is also the tree's labelled data (other labels may be passed in).  Every host's paths form a
tree.  Level by level, the children of a node are generalised into one wildcard where the segment
varies (many children, few urls each) and where branches are statistically alike: only a branch whose
block rate differs from that of all its siblings by a two-proportion z-test keeps its own name.
The paths left are the host's templates; a template is rejected when its smoothed purity, the block
rate with the host's as prior, and the host's with that of all hosts, is high enough.

Trees are built from distinct (host, path shape) rows, digits being one shape, and looked up per url
by a salted join, so a host with a third of all urls is spread.  Only DataFrame functions.

Defined cases: a null url, or one without ``://``, has empty host and path and is judged like any
host; segments past ``DEPTH`` are kept as one.  A very long url is cut
into segments like any other.  Of rules that fit, the longest wins.  Repeated rows get equal verdicts, null ids are kept,
other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import salt_of, salted_lookup
from panelcast.sources.staging import stage

ALLOW, BLOCK = "allow", "block"
DEPTH = 6
#: A segment varies when its node has this many children and at most ``FEW`` urls for each.
MANY, FEW = 16, 4.0
#: A branch keeps its name with this many labelled urls and this distance from its siblings.
LEAST_LABELS, DISTANCE = 5, 1.96
SMOOTHING, REJECT_AT = 4.0, 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null if none; a rule is (verdict, 'host/path')."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern in sorted(rules, key=lambda r: len(r[1])):  # the longest is tested first
        of_host, slash, rest = pattern.partition("/")
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, pattern).otherwise(rule), F.when(fits, name).otherwise(verdict)
    return rule, verdict


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, label (the rule's verdict) and shape (path with digits as one)."""
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, label = rule_of(F.col("host"), F.col("path"), rules)
    return parts.select("page_id", "host", "path", rule.alias("rule"), label.alias("label"), F.regexp_replace("path", "[0-9]+", "0").alias("shape"))


def different(labelled: Column, blocked: Column, all_labelled: Column, all_blocked: Column) -> Column:
    """Is a branch's block rate another than that of its siblings together?"""
    rest, rest_blocked = all_labelled - labelled, all_blocked - blocked
    rate = F.try_divide(all_blocked, all_labelled)
    spread = F.sqrt(rate * (1 - rate) * (F.try_divide(F.lit(1), labelled) + F.try_divide(F.lit(1), rest)))
    z = F.try_divide(F.abs(F.try_divide(blocked, labelled) - F.try_divide(rest_blocked, rest)), spread)
    return F.coalesce((labelled >= LEAST_LABELS) & (rest > 0) & (z > DISTANCE), F.lit(False))


def templates(shapes: DataFrame) -> DataFrame:
    """(host, shape, template) of rows (host, shape, n, labelled, blocked), level by level."""
    segments = F.split("shape", "/")
    level = [F.coalesce(F.get(segments, k), F.lit("")) for k in range(1, DEPTH)]
    level.append(F.array_join(F.slice(segments, F.lit(DEPTH + 1), F.greatest(F.size(segments) - DEPTH, F.lit(0))), "/"))
    tree = shapes.select("host", "shape", "n", "labelled", "blocked", F.lit("").alias("node"), *(c.alias(f"s{k}") for k, c in enumerate(level)))
    for k in range(DEPTH):
        seg = f"s{k}"
        sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
        children = tree.groupBy("host", "node", seg).agg(*sums)
        nodes = children.groupBy("host", "node").agg(F.count("*").alias("k"), *(F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "blocked")))
        varies = (F.col("k") >= MANY) & (F.col("all_n") <= F.col("k") * FEW)
        own = (F.col("k") == 1) | (~varies & different(F.col("labelled"), F.col("blocked"), F.col("all_labelled"), F.col("all_blocked")))
        named = children.join(nodes, ["host", "node"]).select("host", "node", seg, F.when(own, F.col(seg)).otherwise("*").alias("name"))
        # staged, so that the plan does not grow with the levels
        tree = stage(tree.join(named, ["host", "node", seg]).withColumn("node", F.concat("node", F.lit("/"), "name")).drop("name", seg))
    return tree.withColumn("template", F.regexp_replace("node", "/+$", "")).drop("node")


def purities(tree: DataFrame) -> DataFrame:
    """(host, shape, template, purity): smoothed block rate of each template."""
    total = tree.agg(((F.sum("blocked") + 1) / (F.sum("labelled") + 2)).alias("of_all"))
    hosts = tree.groupBy("host").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
    hosts = hosts.join(F.broadcast(total)).select("host", ((F.col("b") + SMOOTHING * F.col("of_all")) / (F.col("l") + SMOOTHING)).alias("of_host"))  # total is one row
    groups = tree.groupBy("host", "template").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).join(hosts, "host")
    groups = groups.select("host", "template", ((F.col("b") + SMOOTHING * F.col("of_host")) / (F.col("l") + SMOOTHING)).alias("purity"))
    return tree.select("host", "shape", "template").join(groups, ["host", "template"])


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], reject_at: float = REJECT_AT) -> DataFrame:
    """Action, stages: page_id, host, path, rule, verdict, template, purity of each row of ``pages``."""
    rows = stage(judged(pages, rules).withColumn("key", F.concat("host", F.lit("\n"), "shape")))
    shapes = rows.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count("label").alias("labelled"), F.count(F.when(F.col("label") == BLOCK, 1)).alias("blocked")
    )
    found = stage(purities(templates(stage(shapes))))
    looked_up = found.select(F.concat("host", F.lit("\n"), "shape").alias("key"), "template", "purity")
    out = salted_lookup(rows, looked_up, "key", salt_of("page_id"))
    method = F.when(F.col("purity") >= reject_at, BLOCK).otherwise(ALLOW)
    return out.select("page_id", "host", "path", "rule", F.coalesce("label", method).alias("verdict"), "template", "purity")


def judge_sql(rules: Sequence[tuple[str, str]]) -> str:
    """The same in SQL over ``pages``: page_id, host, path, rule, verdict."""
    rule = verdict = ""
    for name, pattern in sorted(rules, key=lambda r: -len(r[1])):
        of_host, slash, rest = pattern.partition("/")
        fits = f"WHEN (host = '{of_host}' OR ends_with(host, '.{of_host}')) AND starts_with(path, '{slash}{rest}') THEN"
        rule, verdict = f"{rule} {fits} '{pattern}'", f"{verdict} {fits} '{name}'"
    url = "coalesce(url, '')"
    ctes = [
        f"parts AS (SELECT page_id, translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)",
        f"judged AS (SELECT *, CASE{rule} END AS rule, CASE{verdict} END AS label, regexp_replace(path, '[0-9]+', '0', 'g') AS shape FROM parts)",
        "t0 AS (SELECT host, shape, '' AS node, string_split(shape, '/') AS seg, count(*) AS n, count(label) AS labelled, count(*) FILTER (label = 'block') AS blocked FROM judged GROUP BY ALL)",
    ]
    for k in range(DEPTH):
        seg = f"coalesce(seg[{k + 2}], '')" if k < DEPTH - 1 else f"coalesce(array_to_string(seg[{DEPTH + 1}:], '/'), '')"
        ctes += [
            f"c{k} AS (SELECT host, node, {seg} AS s, sum(n) AS n, sum(labelled) AS l, sum(blocked) AS b FROM t{k} GROUP BY ALL)",
            f"n{k} AS (SELECT *, count(*) OVER w AS k, sum(n) OVER w AS an, sum(l) OVER w AS al, sum(b) OVER w AS ab FROM c{k} WINDOW w AS (PARTITION BY host, node))",
            f"d{k} AS (SELECT *, CASE WHEN l >= {LEAST_LABELS} AND al > l AND ab > 0 AND ab < al THEN abs(b / l - (ab - b) / (al - l)) / sqrt((ab / al) * (1 - ab / al) * (1 / l + 1 / (al - l))) ELSE 0 END AS z FROM n{k})",
            f"t{k + 1} AS (SELECT t.* EXCLUDE (node), t.node || '/' || CASE WHEN k = 1 OR NOT (k >= {MANY} AND an <= k * {FEW}) AND z > {DISTANCE} THEN d.s ELSE '*' END AS node "
            f"FROM t{k} t JOIN d{k} d ON t.host = d.host AND t.node = d.node AND {seg.replace('seg', 't.seg')} = d.s)",
        ]
    ctes += [
        f"g AS (SELECT (sum(blocked) + 1) / (sum(labelled) + 2) AS p FROM t{DEPTH})",
        f"h AS (SELECT host, (sum(blocked) + {SMOOTHING} * any_value(p)) / (sum(labelled) + {SMOOTHING}) AS p FROM t{DEPTH}, g GROUP BY host)",
        f"m AS (SELECT t.host, rtrim(node, '/') AS template, (sum(blocked) + {SMOOTHING} * any_value(p)) / (sum(labelled) + {SMOOTHING}) AS purity FROM t{DEPTH} t JOIN h ON t.host = h.host GROUP BY t.host, rtrim(node, '/'))",
    ]
    return (
        "WITH " + ",\n".join(ctes) + f"\nSELECT j.page_id, j.host, j.path, j.rule, coalesce(j.label, CASE WHEN purity >= {REJECT_AT} THEN 'block' ELSE 'allow' END) AS verdict "
        f"FROM judged j JOIN t{DEPTH} t ON j.host = t.host AND j.shape = t.shape JOIN m ON m.host = t.host AND m.template = rtrim(t.node, '/')"
    )
