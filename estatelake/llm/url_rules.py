"""URL rules as a sort-merge range join with a sorted sweep; DataFrame operations only.

A host is turned round label by label (``www.example.com`` to ``com.example.www.``), so that a host and all its
subdomains are one interval of keys: those that begin with the rule's key. Rules become two events each, the
start and the end of their interval; the end carries the rule that encloses it, which is what a stack of active rules
would show after the inner one is taken off. Sorted by key, the last event before a URL names the
innermost rule that is active there. Path prefixes of the rules are matched first by equality: for each length
that rule paths have, a URL's path is cut to that length. Sweeps are dealt by path prefix, top-level label and a
salt of the row; the rules, not the URLs, are repeated for each salt. Of a URL's innermost rules, one for each
path prefix, the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SALTS = 16
DEFAULT = "allow"
# fixed values: the rules of the registered query
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", id_cols: tuple[str, ...] = ("page_id",), default: str = DEFAULT, salts: int = SALTS) -> DataFrame:
    """One row per row of ``pages``: the id columns, host, path, rule (``host + path``, or null), verdict.

    ``rules``: (host, path, verdict). A rule fits its host and all subdomains where the path begins with its path (``/``
    needs a path). The longest fitting host + path wins; of rules with equal host and path, block wins over
    allow. Rules with a null or an empty host are left out, a null path is empty. Without any fitting rule the verdict is
    ``default``. A null URL or one without ``://`` has an empty host and path and fits none. Repeated rows stay, other columns
    are not read.
    """
    rules = rules.where("host is not null and host != ''").select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("prefix"), "verdict")\
        .groupBy("host", "prefix").agg(F.max("verdict").alias("verdict")).withColumn("rule", F.struct(F.char_length(F.concat("host", "prefix")).alias("length"), F.concat("host", "prefix").alias("text"), "verdict"))
    # the enclosing rule: the longest proper suffix of labels with a rule for the same path prefix
    labels = F.split("host", r"\.")
    outer = rules.withColumn("up", F.explode(F.expr(r"transform(sequence(1, size(split(host, '\\.'))), i -> array_join(slice(split(host, '\\.'), i + 1, 1000000), '.'))")))
    outer = outer.join(rules.select(F.col("host").alias("up"), "prefix", F.col("rule").alias("outer")), ["up", "prefix"]).groupBy("host", "prefix").agg(F.max("outer").alias("outer"))
    events = rules.join(outer, ["host", "prefix"], "left").withColumn("top", F.element_at(labels, -1)).withColumn("key", _key(F.col("host")))
    # "/" follows "." and is in no host, so it closes the interval of all keys that begin with this one
    start = events.select("prefix", "top", "key", F.lit(0).alias("kind"), F.struct("rule").alias("active"))
    end = events.select("prefix", "top", F.regexp_replace("key", r"\.$", "/").alias("key"), F.lit(0).alias("kind"), F.struct(F.col("outer").alias("rule")).alias("active"))
    marks = start.unionByName(end).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    lengths = rules.agg(F.sort_array(F.collect_set(F.char_length("prefix"))).alias("lengths"))  # one row, as many numbers as rule paths have lengths
    prefixes = rules.select("prefix").distinct()
    urls = pages.select(*id_cols, F.col(url_col).alias("url")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    # rows are told apart by a number, as ids may repeat; it is used within this plan only
    row = F.xxhash64(*id_cols, "url")
    urls = urls.withColumn("row", row)
    known = urls.select("row", "host", "path").distinct()
    wanted = known.join(F.broadcast(lengths)).withColumn("n", F.explode("lengths")).where("char_length(path) >= n and host != ''").withColumn("prefix", F.expr("left(path, n)"))
    points = wanted.join(prefixes, "prefix", "left_semi").select("prefix", F.element_at(F.split("host", r"\."), -1).alias("top"), _key(F.col("host")).alias("key"), F.lit(1).alias("kind"), F.pmod("row", F.lit(salts)).cast("int").alias("salt"), "row")
    swept = points.unionByName(marks, allowMissingColumns=True)
    window = Window.partitionBy("prefix", "top", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = swept.withColumn("now", F.last("active", ignorenulls=True).over(window)).where("kind = 1 and now.rule is not null")
    best = active.groupBy("row").agg(F.max("now.rule").alias("rule"))
    return urls.join(best, "row", "left").select(*id_cols, "host", "path", F.col("rule.text").alias("rule"), F.coalesce("rule.verdict", F.lit(default)).alias("verdict"))
