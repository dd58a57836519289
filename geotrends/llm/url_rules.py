"""URL filters as a sort-merge range join, with built-in functions only.

A rule is a host and a path prefix; it fits the host and every subdomain when
the url's path starts with its path. A url is looked up once for each of its
parent hosts: the reversed labels of that host and the path make one string
key, so each rule is the interval of the keys that start with its own key.
Such intervals nest or are apart. Rules and keys are sorted together over
range partitions; the sweep carries the stack of nested rules that the latest
rule key opened, and a key takes the longest rule of the stack that is a
prefix of it. A partition starts with the stack that the ones before it left:
one row per partition, joined by broadcast.

Work is done on distinct (host, path) pairs, so a url that makes up a third of
the rows is one key, and the join back to the rows is left to the run-time
split of skewed partitions.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geotrends.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Between host and path of a key; sorts before all characters of either.
SEP = "\u0001"


def url_parts(url: str) -> list:
    """Host (ASCII letters lower-cased) and path; both empty for null or no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return [
        F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")).alias("host"),
        F.coalesce(path, F.lit("")).alias("path"),
    ]


def _reversed_key(host, path):
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(SEP), path)


def rule_stacks(rules: DataFrame) -> DataFrame:
    """Each rule's key with the chain of rules that enclose it (itself included).

    Enclosing rules have the same host and a path that is a prefix; they are
    found by an equality join on each prefix of the path, so a host with
    many rules is never gathered. Of equal rules the smallest verdict stays.
    """
    distinct = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    prefixes = distinct.select(
        "host", "path", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n")
    ).select("host", "path", F.expr("substring(path, 1, n)").alias("prefix"))
    outer = distinct.select("host", F.col("path").alias("prefix"), "verdict")
    entry = F.struct(
        F.length(F.concat("host", "prefix")).alias("size"), "host", F.col("prefix").alias("path"), "verdict"
    )
    return (
        prefixes.join(outer, ["host", "prefix"])
        .groupBy("host", "path")
        .agg(F.sort_array(F.collect_list(entry)).alias("stack"))
        .select(_reversed_key(F.col("host"), F.col("path")).alias("key"), "stack")
    )


def longest_rules(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) for each target (host, path) that some rule fits.

    The longest rule text wins; of equally long ones that with the longer host.
    """
    labels = F.split("host", r"\.")
    probes = (
        targets.where("host != ''")
        .select("host", "path", F.explode(F.sequence(F.lit(1), F.size(labels))).alias("k"))
        .select("host", "path", F.array_join(F.slice(labels, F.col("k"), F.size(labels)), ".").alias("parent"))
        .select("host", "path", "parent", _reversed_key(F.col("parent"), F.col("path")).alias("key"))
    )
    stacks = rule_stacks(rules)
    events = stacks.select(
        "key", "stack", F.lit(0).alias("kind"), *[F.lit(None).cast("string").alias(c) for c in ("host", "path", "parent")]
    ).unionByName(probes.select("key", "host", "path", "parent", F.lit(1).alias("kind")), allowMissingColumns=True)
    # Equal keys need not stay together: the range also splits by host.
    # The partition number is stored, so both uses below see the same one.
    swept = materialize(
        events.repartitionByRange("key", "kind", "host").withColumn("part", F.spark_partition_id())
    )
    left = swept.where("kind = 0").groupBy("part").agg(F.max_by("stack", "key").alias("left"))
    every = swept.groupBy("part").agg(F.lit(1).alias("one"))
    # One row per partition: a bounded window and a bounded broadcast.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.join(left, "part", "left").select("part", F.last("left", True).over(before).alias("carried"))
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    active = (
        swept.withColumn("latest", F.last("stack", True).over(sweep))
        .where("kind = 1")
        .join(F.broadcast(carried), "part", "left")
        .withColumn("stack", F.coalesce("latest", "carried"))
        .withColumn(
            "fits",
            F.filter(
                "stack",
                lambda r: (r["host"] == F.col("parent")) & F.col("path").startswith(r["path"]),
            ),
        )
        .where(F.size("fits") > 0)
        .withColumn("best", F.element_at("fits", -1))
    )
    return active.groupBy("host", "path").agg(
        F.max_by(
            F.struct(F.concat("parent", F.col("best.path")).alias("rule"), F.col("best.verdict").alias("verdict")),
            F.struct(F.col("best.size"), F.length("parent")),
        ).alias("hit")
    ).select("host", "path", "hit.rule", "hit.verdict")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of these names are replaced.

    A url that is null or has no ``://`` has an empty host and path, no rule
    and the default verdict, as has every url that no rule fits. Repeated
    rows are all kept. With no rules every row gets the default.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parsed = pages.select(*[F.col(f"`{c}`") for c in kept], *url_parts(url))
    hits = longest_rules(pages.select(*url_parts(url)).distinct(), rules)
    joined = parsed.alias("p").join(hits.alias("h"), ["host", "path"], "left")
    return joined.select(
        *[F.col(f"p.`{c}`") for c in kept], "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
