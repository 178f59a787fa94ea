"""Record tables as Parquet snapshots: selections, upserts by a merge policy, partition replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.streaming.progress import written


def unprocessed(records: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Records without a result yet."""
    return records.join(done.select(key), key, "left_anti")


def ready(content: str, length: Column, extra: str, flag: str, least: int = 500, most: int = 30_000) -> Column:
    """Records to be worked on: content of a length between the bounds, and no flag in their JSON."""
    return F.col(content).isNotNull() & (length > least) & (length < most) & F.get_json_object(extra, f"$.{flag}").isNull()


def new_records(batch: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows of a batch whose key is not stored; rows without a key count as new."""
    return batch.join(existing.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def first_seen(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key; rows without a key stay."""
    w = Window.partitionBy(key).orderBy(*order)
    kept = rows.where(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return kept.unionByName(rows.where(F.col(key).isNull()))


def page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """A page (from 1) of a total order; size is at most 100."""
    size = min(max(1, size), 100)
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def page_count(rows: DataFrame, size: int) -> DataFrame:
    """Total and number of pages, at least 1."""
    total = F.count("*")
    return rows.agg(total.alias("total"), F.greatest(F.lit(1), F.ceil(total / size)).cast("int").alias("pages"))


def recent(rows: DataFrame, date: str, created: str, key: str, k: int) -> DataFrame:
    """The k newest rows by a text date, then by when they were made; rows without a date first."""
    return rows.orderBy(F.desc_nulls_first(date), F.desc(created), key).limit(k)


#: How an update meets the stored value of a column.
OVERWRITE, KEEP_IF_EMPTY, GREATEST = "overwrite", "keep_if_empty", "greatest"


def upsert(stored: DataFrame, batch: DataFrame, key: str, policy: dict[str, str], position: str) -> DataFrame:
    """The new snapshot after a batch.

    Repeats of a key within the batch apply in order of position: of a column that keeps its value on
    an empty update the last non-empty one counts.  Rows of the batch without a key are inserted.
    One aggregation of the batch and one full join, both on the key.
    """
    keyed, loose = batch.where(F.col(key).isNotNull() & (F.col(key) != "")), batch.where(F.col(key).isNull() | (F.col(key) == ""))
    full = lambda c: F.when(~(F.col(c).isNull() | (F.col(c).cast("string") == "")), F.col(position))
    last = {OVERWRITE: lambda c: F.max_by(c, position), KEEP_IF_EMPTY: lambda c: F.max_by(c, full(c)), GREATEST: lambda c: F.max(c)}
    folded = keyed.groupBy(key).agg(*(last[p](c).alias(f"_{c}") for c, p in policy.items()), F.lit(True).alias("_new"))
    joined = stored.join(folded, key, "full")
    merged = {OVERWRITE: lambda c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)), KEEP_IF_EMPTY: lambda c: F.coalesce(f"_{c}", c), GREATEST: lambda c: F.greatest(c, f"_{c}")}
    out = joined.select(key, *(merged[p](c).alias(c) for c, p in policy.items()))
    return out.unionByName(loose.select(key, *policy))


def replace_partition(stored: DataFrame, fresh: DataFrame, old: Column) -> DataFrame:
    """Stored rows but those that ``old`` names, and the fresh ones."""
    return stored.where(~F.coalesce(old, F.lit(False))).unionByName(fresh)


def last_wins(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*(o.desc() for o in order))
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def retry_sources(failures: DataFrame, cache: DataFrame, key: str, url: str) -> DataFrame:
    """Failures with the cached copy to retry from: of the same key and url, else one whose url begins with it.

    Beginnings are cut from the cached urls at the lengths of the key's failed ones, so both joins are on
    equal values, and a key with many of both gives no pairs.
    """
    exact = failures.join(cache.groupBy(key, url).agg(F.min("copy").alias("_exact")), [key, url], "left")
    lengths = exact.where(F.col("_exact").isNull()).select(F.col(key), F.length(url).alias("_n")).distinct()
    near = cache.select(key, F.col(url).alias("_u"), "copy").join(lengths, key).where(F.length("_u") >= F.col("_n"))
    near = near.groupBy(key, F.substring("_u", F.lit(1), F.col("_n")).alias(url)).agg(F.min("copy").alias("_near"))
    return exact.join(near, [key, url], "left").select(*failures.columns, F.coalesce("_exact", "_near").alias("copy"))


def split_known(rows: DataFrame, known: list[str]) -> DataFrame:
    """Known columns, and the others as JSON in ``extra``."""
    rest = [c for c in rows.columns if c not in known]
    return rows.select(*(F.coalesce(c, F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes if c in known), F.to_json(F.struct(*rest) if rest else F.create_map().cast("map<string,string>")).alias("extra"))


def merge_json(base: Column, more: Column) -> Column:
    """The union of two JSON objects of strings; the second wins."""
    parse = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    a, b = parse(base), parse(more)
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b))


def csv_rows(*tables: DataFrame) -> DataFrame:
    """Tables under one header, the union of their columns in first-seen order; lists are joined."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.select(*(F.array_join(c, ", ").alias(c) if t.startswith("array") else F.col(c).cast("string").alias(c) for c, t in out.dtypes))


def outcome(content: Column, error: Column) -> Column:
    """failed, partial or success of an extraction."""
    n = F.length(F.trim(F.coalesce(content, F.lit(""))))
    return F.when(error.isNotNull() | (n <= 10), "failed").when(n < 200, "partial").otherwise("success")


def update_content(stored: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Stored rows with new content: a number is kept if there is one, attempts are at least 1.

    updates: key, content, number; a key that is not stored changes nothing.
    """
    new = updates.groupBy(key).agg(F.max_by("content", F.length("content")).alias("_content"), F.max("number").alias("_number"))
    out = stored.join(new, key, "left")
    hit = F.col("_content").isNotNull()
    changed = {"content": F.coalesce("_content", "content"), "number": F.when(hit, F.coalesce(F.nullif("number", F.lit("")), "_number")).otherwise(F.col("number")), "attempts": F.when(hit, F.greatest(F.col("attempts"), F.lit(1))).otherwise(F.col("attempts"))}
    return out.withColumns(changed).drop("_content", "_number")


def reextracted(stored: DataFrame, tried: DataFrame, key: str, position: str, now: Column) -> DataFrame:
    """Stored rows after further extractions: content and all that is known of how it came about.

    stored: content, extraction_status, extraction_method, extraction_error, extraction_attempts,
    extraction_timestamp, content_length, content_hash, updated_at, and any others; tried: key, content,
    method, error, position.  Of several tries of a key the last by position counts, of equal positions the
    one of the greatest content; each is an attempt.  Empty content is a failed extraction, with length 0 and
    no hash.  Keys that are not stored, and tries without a key, change nothing.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    value = F.struct(position, text("content").alias("content"), text("method").alias("method"), text("error").alias("error"))
    last = tried.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(value).alias("_t"), F.count("*").alias("_n"))
    content = F.col("_t.content")
    new = {
        "content": content,
        "extraction_status": F.when(content != "", "success").otherwise("failed"),
        "extraction_method": F.col("_t.method"),
        "extraction_error": F.col("_t.error"),
        "extraction_attempts": F.coalesce("extraction_attempts", F.lit(0)) + F.col("_n"),
        "extraction_timestamp": now,
        "content_length": F.length(content).cast("long"),
        "content_hash": F.when(content != "", F.sha2(content.cast("binary"), 256)).otherwise(""),
        "updated_at": now,
    }
    out = stored.join(last, key, "left")
    hit = F.col("_n").isNotNull()
    return out.select(*(F.when(hit, new[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in new else F.col(f"`{c}`") for c in stored.columns))


def resolved(failures: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Failures with ``resolved`` set for the keys that are done, and one attempt more for the others tried."""
    flag = done.select(key, "ok").groupBy(key).agg(F.max("ok").alias("_ok"))
    out = failures.join(flag, key, "left")
    return out.withColumn("resolved", F.col("resolved") | F.coalesce("_ok", F.lit(False))).withColumn("attempts", F.col("attempts") + F.col("_ok").isNotNull().cast("int")).drop("_ok")


def dead_letter(key: Column, url: Column, kind: Column, message: Column) -> Column:
    """A row of the dead-letter queue; the message is cut at 500 characters."""
    return F.struct(key.alias("document_link"), url.alias("source_url"), kind.alias("error_type"), F.substring(message, 1, 500).alias("error_message"), F.lit(1).alias("attempt_number"), F.lit(False).alias("resolved"))


def with_ids(stored: DataFrame, new: DataFrame, id_col: str, *order: str) -> DataFrame:
    """New rows with ids after the greatest stored one, in order of a total order.

    The numbers are dealt by range partition: counts of the ranges before, plus the place in the range.
    """
    last = stored.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_last"))  # one row
    rows = new.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    rows = written(rows)  # once: the counts and the rows see the same ranges
    rows = rows.withColumn("_part", F.shiftright("_m", 33)).withColumn("_in", F.col("_m").bitwiseAND((1 << 33) - 1))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # a row for each range
    out = rows.join(F.broadcast(before), "_part").crossJoin(F.broadcast(last))
    return out.withColumn(id_col, F.col("_last") + F.col("_before") + F.col("_in") + 1).drop("_m", "_part", "_in", "_before", "_last")


def with_fallback(content: Column, page: Column, least: int = 50) -> Column:
    """The page's text where the content is short and the page has more."""
    n, m = (F.length(F.coalesce(c, F.lit(""))) for c in (content, page))
    return F.when((n < least) & (m > n), page).otherwise(content)


def index_summary(rows: DataFrame, content: str, source: str) -> DataFrame:
    """One row: records, those with content, and the sources in order, joined."""
    return rows.agg(F.count("*").alias("records"), F.count_if(~(F.col(content).isNull() | (F.col(content) == ""))).alias("with_content"), F.array_join(F.sort_array(F.collect_set(source)), ",").alias("sources"))


def most_common(rows: DataFrame, by: str, k: int) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), by).limit(k)
