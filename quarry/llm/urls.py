"""URL filters (operator 3): a sort-merge range join of urls with nested prefix rules.

A host is turned into a key of its labels in reverse order, each followed by a dot
(``www.example.org`` is ``org.example.www.``), so that a rule's host with all its subdomains is the
interval of keys that start with the rule's key.  Such intervals are nested or disjoint.  Rule starts
and urls are sorted together by key and range-partitioned; a sweep over each range keeps, with the
last rule start passed, the stack of rules around it, and the rules that still hold at a key are what
remains of the stack once those that ended before it are popped.  Paths are matched by the same sweep,
over rule host and path.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import by_column, materialize

#: The query's rules: action, host, path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """The columns of urls with host and path; both are empty for a null url or one without ``://``."""
    rest = F.expr(f"case when instr(`{url_col}`, '://') > 0 then substring(`{url_col}`, instr(`{url_col}`, '://') + 3) end")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return urls.drop("host", "path").withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})


def host_key(host: Column) -> Column:
    """Labels in reverse order, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def stacks(keys: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(key, stack): for every key the prefixes that it starts with, shortest first, where there are any.

    keys: distinct (key); prefixes: distinct (prefix).  No key is dealt out more than once, so a range
    has about as many rows as any other, however urls crowd on one host.
    """
    own = prefixes.select("prefix", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("prefix")))).alias("n"))
    own = own.select("prefix", F.expr("substring(prefix, 1, n)").alias("outer"))
    around = own.join(prefixes.select(F.col("prefix").alias("outer")), "outer")  # the rules around each rule, itself included
    around = around.groupBy("prefix").agg(F.array_sort(F.collect_set("outer")).alias("stack"))
    events = keys.select("key", F.lit(1).alias("kind"), F.lit(None).cast("array<string>").alias("stack"))
    events = events.unionByName(around.select(F.col("prefix").alias("key"), F.lit(0).alias("kind"), "stack"))
    events = events.repartitionByRange("key", "kind").withColumn("range", F.spark_partition_id())
    events = materialize(events, "sweep")  # the bounds of ranges are drawn once
    last = events.groupBy("range").agg(F.expr("max_by(stack, key) filter (where kind = 0)").alias("stack"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    carried = last.select(F.lit("").alias("key"), F.lit(-1).alias("kind"), F.last("stack", True).over(before).alias("stack"), "range")
    sweep = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.unionByName(carried.where("stack is not null")).withColumn("stack", F.last("stack", True).over(sweep))
    held = F.expr("filter(stack, p -> startswith(key, p))")
    return swept.where("kind = 1").select("key", held.alias("stack")).where("size(stack) > 0")


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url") -> DataFrame:
    """The columns of urls, whatever their names, with host, path, rule and verdict (which replace any of
    these names).

    rules: (action, host, path).  A rule fits its host and all subdomains if the url's path starts
    with its path.  Of those that fit the longest (host and path together, then host) wins; of equal
    rules with two actions ``block`` wins; rules with a null are left out.  Without a rule, and for a
    null or malformed url, rule is null and the verdict is ``default``.
    """
    rules = rules.where("action is not null and host is not null and path is not null").select("action", F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"))
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("action").alias("action"))
    names = urls.drop("host", "path", "rule", "verdict").columns
    own = [f"c{i}" for i in range(len(names))]  # the input's names may be any
    split = parts(urls.select(*(F.col(f"`{c}`") for c in names)).toDF(*own), own[names.index(url_col)])
    places = materialize(split.groupBy("host", "path").agg(F.first(host_key(F.col("host"))).alias("key")).where("host <> ''"), "places")
    # written before they are joined, so that Spark can split the rows of a frequent host or url
    hosts = materialize(stacks(places.select("key").distinct(), rules.select(host_key(F.col("rule_host")).alias("prefix")).distinct()), "hosts")
    # a url's path under each of the rule hosts that hold for it: at most as many as its host has labels
    under = places.join(hosts.select("key", F.explode("stack").alias("outer")), "key").select("host", "path", F.concat("outer", F.lit("\x01"), "path").alias("key"))
    named = rules.withColumn("prefix", F.concat(host_key(F.col("rule_host")), F.lit("\x01"), "rule_path"))
    found = stacks(under.select("key").distinct(), named.select("prefix")).select("key", F.element_at("stack", -1).alias("prefix"))
    size = F.length(F.concat("rule_host", "rule_path"))
    best = under.join(found, "key").join(named, "prefix").groupBy("host", "path").agg(F.max(F.struct(size.alias("size"), F.length("rule_host").alias("n"), F.concat("rule_host", "rule_path").alias("rule"), "action")).alias("best"))
    out = split.join(materialize(best, "best"), ["host", "path"], "left")
    return out.select(*own, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")).toDF(*names, "host", "path", "rule", "verdict")


def op3_urls(spark, sf_dir) -> DataFrame:
    """Every page's url under RULES."""
    rules = spark.sql("select * from values " + ", ".join(map(str, RULES)) + " as t(action, host, path)")
    return judge(by_column(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
with rest as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as r from pages),
parts as (select page_id, coalesce(translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') as path from rest),
rules(action, h, p) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits as (select page_id, host, path, h || p as rule, action,
  row_number() over (partition by page_id, host, path order by length(h || p) desc nulls last) as k
  from parts left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select page_id, host, path, rule, coalesce(action, 'allow') as verdict from fits where k = 1
"""
