"""All queries of the reference's operators over the test tables, with their SQL for DuckDB.

documents stand for crawled records, labels for extracted results, embeddings for the vector
collection, orders of a customer for circulars that supersede each other, nations and regions for
entities, pages for crawled HTML, events for failures and progress.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import dictionary as D
from quarry.functions import fixed_values as V
from quarry.functions import text as T
from quarry.operators import answers as AN
from quarry.operators import assistant as AS
from quarry.operators import audit as A
from quarry.operators import batch_evaluation as BE
from quarry.operators import evaluation as E
from quarry.operators import graph as G
from quarry.operators import keywords as K
from quarry.operators import records as R
from quarry.operators import retrieval as S
from quarry.operators import sections as C
from quarry.operators import vectors as VI
from quarry.sources import buckets as B
from quarry.sources import connectors as N
from quarry.sources import html as H
from quarry.sources import records as SR
from quarry.sources import sinks as SK
from quarry.streaming import progress as P
from quarry.streaming import workers as W

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Records derived from documents, as SQL that both engines read.
RECORD = """doc_id as id, text as content, source as crawler, lang as department, n_chars,
case doc_id % 5 when 0 then 'CBDT (circular)' when 1 then 'RBI (notifications)' when 2 then 'SEBI-orders' when 3 then '' else 'Gst_Council' end as source,
case doc_id % 11 when 0 then 'Master Direction on KYC' when 1 then 'Amendment to NPA norms' when 2 then 'NPA classification norms' when 3 then 'Staff memo on office timing' when 4 then 'RBI/2023-2024/100 - Some circular' when 5 then 'Digital lending framework' when 6 then 'Guidelines for 2022 fiscal year' when 7 then 'Revised framework for ECB' when 8 then 'RBI/2025-2026/225 Basel III' when 9 then 'Holiday list for 2023' else 'General office circular' end as title,
case doc_id % 9 when 0 then 'Mar 04, 2025' when 1 then '10-01-2022' when 2 then '02.03.2026' when 3 then '15/06/2023' when 4 then '10-Jan-2022' when 5 then 'January 15, 2021' when 6 then '2024-06-15' when 7 then '' else null end as date,
case doc_id % 4 when 0 then 'SLR | 02.3.2026 | text' when 1 then 'Ref: 15.12.2019 circular' when 2 then '' else null end as details,
case when doc_id % 7 = 0 then null else concat('https://example.org/', cast(doc_id % 400 as varchar(20))) end as link,
case when doc_id % 3 = 0 then '' else concat('RBI/2024-25/', cast(doc_id as varchar(20))) end as number"""
RECORDS = f"with records as (select {RECORD} from documents) "


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*_items(RECORD.replace("varchar(20)", "string")))


def _items(select: str) -> list[str]:
    """The items of a select list (commas within brackets do not count)."""
    out, depth, now = [], 0, ""
    quoted = False
    for c in select:
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and depth == 0 and not quoted:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


# ---- audits -----------------------------------------------------------------------------------


@query("""select source as crawler, count(*) as total, count(quality) as with_content, count(*) - count(quality) as empty_content,
round(100.0 * count(quality) / nullif(count(*), 0), 1) as pct from documents d left join (select distinct doc_id, 1 as quality from labels) l using (doc_id) group by 1""")
def audit_coverage(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select("doc_id", F.lit("1").alias("content")).distinct()
    return A.coverage(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("crawler")).join(done, "doc_id", "left"), "crawler", "content")


@query("""select source as crawler, count(*) filter (where n_chars = 500) as exact_500, count(*) filter (where n_chars = 1000) as exact_1000,
count(*) filter (where n_chars between 490 and 510) as near_500, count(*) filter (where n_chars between 990 and 1010) as near_1000 from documents group by 1
having count(*) filter (where n_chars between 490 and 510) > 0 or count(*) filter (where n_chars between 990 and 1010) > 0""")
def audit_truncation(spark, sf_dir):
    return A.truncation(table(spark, sf_dir, "documents").withColumnRenamed("source", "crawler"), "crawler", F.col("n_chars"), (500, 1000))


@query("""select source as crawler, count(*) filter (where l.doc_id is not null) as with_attachment, count(*) filter (where l.doc_id is not null and n_chars < 500) as gap
from documents d left join (select distinct doc_id from labels) l using (doc_id) group by 1 having count(*) filter (where l.doc_id is not null and n_chars < 500) > 0""")
def audit_pdf_gaps(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("has")).distinct()
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.col("source").alias("crawler")).join(labels, "doc_id", "left")
    return A.attachment_gaps(rows, "crawler", F.coalesce("has", F.lit(False)), F.col("n_chars") >= 500)


@query("""select user_id % 10 as crawler, json_extract_string(props, '$.k') as error_type, count(*) as cnt from events where event_type = 'error' group by 1, 2""")
def audit_dead_letter(spark, sf_dir):
    bad = table(spark, sf_dir, "events").where("event_type = 'error'").select((F.col("user_id") % 10).alias("crawler"), F.get_json_object("props", "$.k").alias("error_type"))
    return A.dead_letters(bad, "crawler", "error_type")


@query("""select source as crawler, count(distinct d.doc_id) as docs, count(distinct l.doc_id) as cached, count(distinct d.doc_id) - count(distinct l.doc_id) as missing
from documents d left join labels l on l.doc_id = d.doc_id group by 1""")
def audit_cache_completeness(spark, sf_dir):
    return A.cache_completeness(table(spark, sf_dir, "documents").withColumnRenamed("source", "crawler"), table(spark, sf_dir, "labels"), "doc_id", "crawler")


_METHOD = "case when n_chars < 50 then 'ocr' when n_chars < 500 then 'mixed' else 'text' end"


@query(f"select source as crawler, {_METHOD} as method, count(*) as cnt from documents group by 1, 2")
def audit_method_distribution(spark, sf_dir):
    return A.distribution(table(spark, sf_dir, "documents").withColumnRenamed("source", "crawler"), "crawler", F.expr(_METHOD))


@query("select source as crawler, count(*) as cnt, min(n_chars) as shortest, cast(round(avg(n_chars)) as integer) as mean_length from documents where n_chars > 0 and n_chars < 500 group by 1")
def audit_short_content(spark, sf_dir):
    return A.short_content(table(spark, sf_dir, "documents").withColumnRenamed("source", "crawler"), "crawler", F.col("n_chars"))


# ---- selections and reports -------------------------------------------------------------------


@query("select doc_id, source, n_chars from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id) and n_chars > 500 and n_chars < 30000 and doc_id % 3 <> 0 order by n_chars desc, doc_id limit 50")
def unprocessed_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("extra", F.expr("case when doc_id % 3 = 0 then '{\"extracted\": true}' when doc_id % 3 = 1 then '{}' end"))
    docs = docs.where(R.ready("text", F.col("n_chars"), "extra", "extracted")).select("doc_id", "source", "n_chars")
    return R.unprocessed(docs, table(spark, sf_dir, "labels"), "doc_id").orderBy(F.desc("n_chars"), "doc_id").limit(50)


@query(RECORDS + "select id, link from records where (content is null or content = '' or n_chars < 100) and link is not null")
def missing_content(spark, sf_dir):
    return records(spark, sf_dir).where((A.missing("content") | (F.col("n_chars") < 100)) & F.col("link").isNotNull()).select("id", "link")


def _results(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return table(spark, sf_dir, "labels").join(docs, "doc_id", "left").where("toxic = 0 and lang = 'en'")


@query("select doc_id, source, quality from labels left join documents using (doc_id) where toxic = 0 and lang = 'en' order by quality desc nulls last, doc_id limit 20 offset 20")
def obligations_page(spark, sf_dir):
    return R.page(_results(spark, sf_dir).select("doc_id", "source", "quality"), 2, 20, F.desc_nulls_last("quality"), F.col("doc_id"))


@query("select count(*) as total, cast(greatest(1, ceil(count(*) / 20.0)) as integer) as pages from labels left join documents using (doc_id) where toxic = 0 and lang = 'en'")
def obligations_count(spark, sf_dir):
    return R.page_count(_results(spark, sf_dir), 20)


@query("select count(*) as n_rows, cast(sum(len(string_split(text, ' '))) as bigint) as obligations, cast(sum(n_chars // 100) as bigint) as thresholds, count(*) filter (where toxic = 1) as high, count(*) filter (where quality is not null) as linked from documents left join labels using (doc_id)")
def dashboard_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.agg(F.count("*").alias("n_rows"), F.sum(F.size(F.split("text", " "))).alias("obligations"), F.sum(F.expr("n_chars div 100")).alias("thresholds"), F.count_if(F.col("toxic") == 1).alias("high"), F.count_if(F.col("quality").isNotNull()).alias("linked"))


@query(RECORDS + "select id, date, n_chars from records order by date desc nulls first, n_chars desc, id limit 30")
def recent_records(spark, sf_dir):
    return R.recent(records(spark, sf_dir), "date", "n_chars", "id", 30).select("id", "date", "n_chars")


@query("select l.doc_id as id, l.quality, d.source from labels l left join (select * from documents where doc_id % 5 <> 0) d using (doc_id) where date '2024-01-01' + cast(l.doc_id % 300 as integer) >= date '2024-06-01'")
def obligations_since(spark, sf_dir):
    made = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")).cast("timestamp")
    results = table(spark, sf_dir, "labels").withColumn("created_at", made).withColumn("id", F.col("doc_id"))
    docs = table(spark, sf_dir, "documents").where("doc_id % 5 <> 0").select("doc_id", "source")
    return SR.obligations(results, docs, "2024-06-01").select("id", "quality", "source")


@query("select doc_id, case when doc_id % 3 < 2 then 'about ' || source end as subject from documents")
def extraction_forms(spark, sf_dir):
    held = F.to_json(F.struct(F.concat(F.lit("about "), "source").alias("subject")))
    quoted = F.to_json(F.array(held))
    text = F.when(F.col("doc_id") % 3 == 0, held).when(F.col("doc_id") % 3 == 1, F.substring(quoted, F.lit(2), F.length(quoted) - 2)).otherwise("not JSON")
    return table(spark, sf_dir, "documents").select("doc_id", F.get_json_object(SR.extraction_text(text), "$.subject").alias("subject"))


@query("select distinct split_part(source, 'c', 2) as source from documents where lang in ('en', 'de') and source like 'src1%'")
def source_filter_values(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.col("lang").isin("en", "de") & F.col("source").startswith("src1"))
    return docs.select(F.split_part("source", F.lit("c"), F.lit(2)).alias("source")).distinct()


# ---- text functions ---------------------------------------------------------------------------

_STRPTIME = "['%b %d, %Y', '%d-%m-%Y', '%d.%m.%Y', '%d/%m/%Y', '%d-%b-%Y', '%B %d, %Y', '%Y-%m-%d']"
_YEAR_SQL = rf"""coalesce(year(try_strptime(trim(date), {_STRPTIME})), try_cast(nullif(regexp_extract(coalesce(details, ''), '\b(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})\b', 3), '') as integer),
try_cast(nullif(regexp_extract(coalesce(title, '') || ' ' || coalesce(details, ''), 'RBI/(\d{{4}})-(\d{{4}})/', 2), '') as integer), try_cast(nullif(regexp_extract(coalesce(title, ''), '\b((19|20)\d{{2}})\b', 1), '') as integer))"""


@query(
    RECORDS
    + f""", years as (select id, coalesce(title, '') || ' ' || coalesce(details, '') as t, cast({_YEAR_SQL} as integer) as year from records)
select id, year, regexp_matches(t, '{V.MASTER}') or regexp_matches(t, '{V.AMENDMENT}') or (coalesce(year < 2024, true) and regexp_matches(t, '{V.KEYWORDS}')) as keep from years"""
)
def importance_filter(spark, sf_dir):
    c = [F.col(x) for x in ("title", "date", "details")]
    return records(spark, sf_dir).select("id", T.record_year(*c).alias("year"), T.is_important(*c).alias("keep"))


_SOURCES_SQL = ", ".join(f"'{s}'" for s in V.VALID_SOURCES)
_BASE_SQL = r"lower(trim(regexp_replace(source, '\s*\(.*\)\s*$', '')))"


@query(
    RECORDS
    + rf"""select id, case when coalesce(source, '') = '' then 'other' when {_BASE_SQL} in ({_SOURCES_SQL}) then {_BASE_SQL} else lower(source) end as source_key,
case when coalesce(source, '') = '' then 'Unknown' when upper(trim(string_split_regex(source, '[(\-/]')[1])) <> '' then upper(trim(string_split_regex(source, '[(\-/]')[1])) else upper(trim(source)) end as display from records"""
)
def normalize_source(spark, sf_dir):
    return records(spark, sf_dir).select("id", T.normalize_source(F.col("source")).alias("source_key"), T.display_source(F.col("source")).alias("display"))


@query(RECORDS + "select id, coalesce(strftime(try_strptime(trim(date), ['%B %d, %Y', '%b %d, %Y', '%d-%m-%Y', '%d-%b-%Y']), '%Y-%m-%d'), trim(date), '') as iso from records")
def normalize_date(spark, sf_dir):
    return records(spark, sf_dir).select("id", T.iso_date(F.col("date")).alias("iso"))


_SIZED = "concat('(\n', cast(doc_id % 900 as varchar(9)), ' KB\n)\n\n\n\n', text, '\n\n\n\n\nend  ')"


@query("select doc_id, sha256(cleaned) as cleaned_sha256, length(cleaned) as n from (select doc_id, trim(regexp_replace(regexp_replace(" + _SIZED.replace("\n", "' || chr(10) || '") + r", '(?is)^\(\s*\d+\s*kb\s*\)\s*', ''), '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || chr(13) || chr(9) || ' ') as cleaned from documents)")
def clean_content(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_SIZED.replace("varchar(9)", "string")).alias("t"))
    out = docs.select("doc_id", T.clean_content(F.col("t")).alias("c"))
    return out.select("doc_id", F.sha2(F.col("c").cast("binary"), 256).alias("cleaned_sha256"), F.length("c").cast("long").alias("n"))


@query("select doc_id, case when coalesce(text, '') <> '' then sha256(text) end as content_hash, length(text) as content_length from documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"), F.length("text").cast("long").alias("content_length"))


_CLEANED = r"trim(regexp_replace(regexp_replace(coalesce(content, ''), '(?is)^\(\s*\d+\s*kb\s*\)\s*', ''), '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || chr(13) || chr(9) || ' ')"


@query(
    RECORDS
    + """select id, concat_ws(' | ', 'Source: ' || coalesce(source, 'Unknown'), 'Title: ' || coalesce(title, 'Untitled'),
case when coalesce(strftime(try_strptime(trim(date), ['%B %d, %Y', '%b %d, %Y', '%d-%m-%Y', '%d-%b-%Y']), '%Y-%m-%d'), trim(date), '') <> '' then 'Date: ' || coalesce(strftime(try_strptime(trim(date), ['%B %d, %Y', '%b %d, %Y', '%d-%m-%Y', '%d-%b-%Y']), '%Y-%m-%d'), trim(date), '') end,
case when number <> '' then 'Circular Number: ' || number end, 'Link: ' || link) as header, sha256(case when """ + _CLEANED + """ <> '' then """ + _CLEANED + """ else concat_ws(chr(10) || chr(10), coalesce(title, 'Untitled'), nullif(details, '')) end) as body from records"""
)
def document_header(spark, sf_dir):
    c = [F.col(x) for x in ("source", "title", "date", "number", "link", "content", "details")]
    said = T.document_text(*c)
    return records(spark, sf_dir).select("id", F.regexp_extract(said, r"(?s)^\[(.*?)\]\n\n", 1).alias("header"), F.sha2(F.regexp_extract(said, r"(?s)^\[.*?\]\n\n(.*)$", 1).cast("binary"), 256).alias("body"))


@query(
    r"""with w as (select doc_id, list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z]{2,}') and x not in ('PDF', 'FAQ', 'URL', 'API')) as a from documents)
select doc_id, coalesce(list_aggregate(list_slice(a, 1, 3), 'string_agg', ','), '') as keywords from w"""
)
def acronym_keywords(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.acronyms(F.col("text")), ",").alias("keywords"))


@query(
    r"""with p as (select doc_id, list_filter(list_transform(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\n\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as ps from documents),
m as (select doc_id, list_transform(ps, lambda x, i: case when i > 1 then chr(10) || chr(10) else '' end || regexp_replace(x, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g')) as ms from p)
select doc_id, cast(len(string_split(array_to_string(ms, chr(1)), chr(1))) as bigint) as n_sentences, sha256(array_to_string(ms, chr(1))) as sentences from m"""
)
def sentence_split(spark, sf_dir):
    cut = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("s"))
    return cut.select("doc_id", F.greatest(F.size("s"), F.lit(1)).cast("long").alias("n_sentences"), F.sha2(F.array_join("s", "\x01").cast("binary"), 256).alias("sentences"))


_HEADING = "case id % 8 when 0 then 'Definitions' when 1 then 'Scope of this direction' when 2 then 'Exemptions' when 3 then 'Limits' when 4 then 'Filing' when 5 then 'Compliance' else 'Notes' end"
_BODY = "case id % 6 when 0 then 'Banks shall file the return within 30 days and must keep records.' when 1 then 'Exposure of 10 % or 5 crore.' when 2 then 'This shall not apply to them.' when 3 then 'It applies to all banks.' when 4 then 'Rs. 500 and Rs 700 only' else 'Nothing here' end"


def _type_sql() -> str:
    cases = []
    for name, words, patterns, least in V.SECTION_TYPES:
        hits = " or ".join(f"contains(lower(h), '{w}')" for w in words)
        count = " + ".join(f"regexp_matches(lower(b), '{p}')::int" for p in patterns)
        cases.append(f"when {hits} or {count} >= {least} then '{name}'")
    return "case " + " ".join(cases) + " else 'general' end"


@query(RECORDS + f"select id, {_type_sql()} as section_type from (select id, {_HEADING} as h, content || ' ' || {_BODY} || ' ' || content as b from records)")
def section_type(spark, sf_dir):
    rows = records(spark, sf_dir).select("id", F.expr(_HEADING).alias("h"), F.concat_ws(" ", "content", F.expr(_BODY), "content").alias("b"))
    return rows.select("id", T.section_type(F.col("h"), F.col("b")).alias("section_type"))


@query("select doc_id, cast(('0x' || substr(sha256(concat(source, ':', cast(doc_id as varchar), ':chunk_', cast(doc_id % 5 as varchar))), 1, 15)) as bigint) as point_id from documents")
def point_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.point_id(T.chunk_id(F.col("source"), F.col("doc_id").cast("string"), F.col("doc_id") % 5)).alias("point_id"))


_QUESTION = "case item_id % 6 when 0 then concat('What changed in RBI/2024-2025/', cast(item_id as varchar(9)), ' today?') when 1 then 'Explain Section 16 of the CGST Act' when 2 then 'rule 89a of CGST Rules' when 3 then 'sebi/2023-24/77 latest version and amendment history of KYC?' when 4 then 'How has the compliance procedure for NBFC and ECB limits changed over time?' else 'Which entities must comply, what is the impact?' end"
_QUESTIONS = f"with q as (select item_id, text || ' ' || {_QUESTION} || ' ' || text as q from benchmark) "


def questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.concat_ws(" ", "text", F.expr(_QUESTION.replace("varchar(9)", "string")), "text").alias("q"))


@query(
    _QUESTIONS
    + rf"""select item_id, nullif(regexp_replace(upper(regexp_extract(q, '{V.QUESTION_REFERENCE}')), '(\d{{4}})-\d{{2}}(\d{{2}})', '\1-\2'), '') as number,
case when regexp_extract(q, '{V.SECTION_OF_ACT}', 1) <> '' then replace(upper(regexp_extract(q, '{V.SECTION_OF_ACT}', 2)), ' ', '_') || '-S' || regexp_extract(q, '{V.SECTION_OF_ACT}', 1)
when regexp_extract(q, '{V.RULE_OF_RULES}', 1) <> '' then replace(upper(regexp_extract(q, '{V.RULE_OF_RULES}', 2)), ' ', '_') || '_RULES-R' || regexp_extract(q, '{V.RULE_OF_RULES}', 1) end as section from q"""
)
def question_references(spark, sf_dir):
    return questions(spark, sf_dir).select("item_id", T.question_number(F.col("q")).alias("number"), T.section_reference(F.col("q")).alias("section"))


@query("select doc_id, case when strpos(text, ' the ') > 0 and strpos(text, ' of ') > strpos(text, ' the ') then substr(text, strpos(text, ' the '), strpos(text, ' of ') - strpos(text, ' the ') + 4) else text end as excerpt from documents")
def marker_excerpt(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.excerpt(F.col("text"), F.lit(" the "), F.lit(" of ")).alias("excerpt"))


_WORD_STOP = ("the", "and", "that", "was", "are", "with", "for")


@query("select item_id, list_aggregate(list_filter(list_transform(string_split_regex(lower(text), '\\s+'), lambda w: trim(w, '?,.''\"')), lambda w: length(w) > 2 and w not in ('the', 'and', 'that', 'was', 'are', 'with', 'for')), 'string_agg', ' ') as terms from benchmark")
def key_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.key_terms(F.col("text"), _WORD_STOP), " ").alias("terms"))


# ---- taxonomies and intents -------------------------------------------------------------------

#: A taxonomy for the generated text (the general operator takes any).
TAXONOMY = {"alpha": ("ther", "tion", "onen"), "beta": ("eau", "ment", "elle"), "gamma": ("keit", "lich", "ung"), "delta": ("ción", "mente", "las "), "epsilon": ("license", "rights", "token")}


def _count_sql(text: str, words) -> str:
    return " + ".join("contains({}, '{}')::int".format(text, w.replace("'", "''")) for w in words)


_TOPIC_ROWS = " union all ".join(f"select doc_id, '{n}' as topic, {i} as pos, {_count_sql('lower(substr(text, 1, 2000))', ws)} as cnt from documents" for i, (n, ws) in enumerate(TAXONOMY.items()))


@query(f"select doc_id, topic, rn as rank from (select *, row_number() over (partition by doc_id order by cnt desc, pos) as rn from ({_TOPIC_ROWS}) where cnt >= 2) where rn <= 3")
def topic_assign(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(S.topics(F.substring("text", 1, 2000), TAXONOMY)).alias("i", "topic"))
    return docs.select("doc_id", "topic", (F.col("i") + 1).cast("long").alias("rank"))


_INTENT_ROWS = " union all ".join(f"select item_id, '{n}' as name, {i} as pos, {_count_sql('lower(q)', ws)} as cnt from q" for i, (n, ws) in enumerate(V.INTENT_WORDS.items()))
_TYPE_ROWS = " union all ".join(f"select item_id, '{n}' as name, {i} as pos, {_count_sql('lower(q)', ws)} as cnt from q" for i, (n, ws) in enumerate(V.TYPE_WORDS.items()))


@query(
    _QUESTIONS
    + f""", i as (select item_id, name from (select *, row_number() over (partition by item_id order by cnt desc, pos) as rn from ({_INTENT_ROWS}) where cnt > 0) where rn = 1),
t as (select item_id, string_agg(name, ',' order by pos) as types from ({_TYPE_ROWS}) where cnt > 0 group by 1)
select q.item_id, i.name as intent, coalesce(t.types, '') as types from q left join i using (item_id) left join t using (item_id)"""
)
def intent_detect(spark, sf_dir):
    types = F.array_join(F.transform(S.matched_words(F.col("q"), V.TYPE_WORDS), lambda c: c["name"]), ",")
    return questions(spark, sf_dir).select("item_id", S.most_matched(F.col("q"), V.INTENT_WORDS).alias("intent"), types.alias("types"))


# ---- upserts and snapshots --------------------------------------------------------------------

_OLD = "select link, title, content, n_chars from (select *, row_number() over (partition by link order by id) as rn from records where link is not null and id % 2 = 0) where rn = 1"
_NEW = "select id, link, title, case when id % 3 = 0 then '' else content end as content, n_chars from records where id % 2 = 1"


@query(
    RECORDS
    + f""", old as ({_OLD}), new as ({_NEW}), folded as (select link, arg_max(title, id) as title, arg_max(content, id) filter (where content <> '') as content, max(n_chars) as n_chars from new where link is not null group by 1)
select coalesce(o.link, n.link) as link, case when n.link is not null then n.title else o.title end as title, sha256(coalesce(n.content, o.content)) as content, greatest(o.n_chars, n.n_chars) as n_chars from old o full join folded n on o.link = n.link
union all select link, title, sha256(content), n_chars from new where link is null"""
)
def upsert_merge(spark, sf_dir):
    r = records(spark, sf_dir)
    old = R.first_seen(r.where("link is not null and id % 2 = 0"), "link", "id").select("link", "title", "content", "n_chars")
    new = r.where("id % 2 = 1").select("id", "link", "title", F.when(F.col("id") % 3 == 0, "").otherwise(F.col("content")).alias("content"), "n_chars")
    out = R.upsert(old, new, "link", {"title": R.OVERWRITE, "content": R.KEEP_IF_EMPTY, "n_chars": R.GREATEST}, "id")
    return out.select("link", "title", F.sha2(F.col("content").cast("binary"), 256).alias("content"), "n_chars")


@query("select doc_id, lang, 'old' as version from documents where not (lang = 'de' and doc_id % 10 < 8) union all select doc_id + 1000000 as doc_id, lang, 'new' as version from documents where lang = 'de' and doc_id % 2 = 0")
def replace_partition(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    fresh = docs.where("lang = 'de' and doc_id % 2 = 0").select((F.col("doc_id") + 1000000).alias("doc_id"), "lang", F.lit("new").alias("version"))
    return R.replace_partition(docs.withColumn("version", F.lit("old")), fresh, F.expr("lang = 'de' and doc_id % 10 < 8"))


@query(RECORDS + "select id, link from records r where id % 2 = 1 and (link is null or not exists (select 1 from records o where o.id % 2 = 0 and o.link = r.link))")
def incremental_new_records(spark, sf_dir):
    r = records(spark, sf_dir).select("id", "link")
    return R.new_records(r.where("id % 2 = 1"), r.where("id % 2 = 0").select("link"), "link").select("id", "link")


_FAILURES = "select event_id, user_id % 50 as k, concat('u/', cast(event_id % 7 as varchar(9))) as url from events where event_type = 'error'"
_CACHE = "select doc_id as copy, doc_id % 50 as k, case when doc_id % 3 = 0 then concat('u/', cast(doc_id % 7 as varchar(9))) else concat('u/', cast(doc_id % 7 as varchar(9)), '?p=1') end as url from documents"


@query(
    f"""with f as ({_FAILURES}), c as ({_CACHE}), exact as (select f.*, (select min(copy) from c where c.k = f.k and c.url = f.url) as e from f)
select event_id, k, url, coalesce(e, (select min(copy) from c where c.k = x.k and starts_with(c.url, x.url))) as copy from exact x"""
)
def dlq_retry_join(spark, sf_dir):
    fix = lambda sql: sql.replace("varchar(9)", "string")
    failures = table(spark, sf_dir, "events").where("event_type = 'error'").selectExpr(*_items(fix(_FAILURES)[7:].split(" from ")[0]))
    cache = table(spark, sf_dir, "documents").selectExpr(*_items(fix(_CACHE)[7:].split(" from ")[0]))
    return R.retry_sources(failures, cache, "k", "url")


@query("select doc_id, case when err or length(trim(t)) <= 10 then 'failed' when length(trim(t)) < 200 then 'partial' else 'success' end as outcome from (select doc_id, coalesce(text, '') as t, doc_id % 13 = 0 as err from documents)")
def extraction_outcome(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr("case when doc_id % 13 = 0 then 'timeout' end").alias("e"))
    return docs.select("doc_id", R.outcome(F.col("text"), F.col("e")).alias("outcome"))


_TRIED = "select doc_id as id, case when doc_id % 5 = 0 then '' else text || ' again' end as content, case when doc_id % 2 = 0 then 'tables' else 'plain' end as method, case when doc_id % 5 = 0 then 'no text' else '' end as error, doc_id % 7 as pos from documents where doc_id % 3 = 0"


@query(
    f"""with n as ({_TRIED} union all select doc_id, 'again', 'ocr', null, 9 from documents where doc_id % 12 = 0), t as (select id, count(*) as tries, arg_max(content, pos) as c, arg_max(method, pos) as m, arg_max(coalesce(error, ''), pos) as e from n group by 1)
select doc_id as id, sha256(case when t.id is null then text else c end) as content, case when t.id is null then 'success' when c = '' then 'failed' else 'success' end as extraction_status, coalesce(m, 'plain') as extraction_method, coalesce(e, '') as extraction_error,
1 + coalesce(tries, 0) as extraction_attempts, case when t.id is null then '2024-01-01' else '2025-06-30' end as extraction_timestamp, cast(case when t.id is null then n_chars else length(c) end as bigint) as content_length, case when t.id is null then 'old' when c = '' then '' else sha256(c) end as content_hash,
case when t.id is null then '2024-01-01' else '2025-06-30' end as updated_at from documents left join t on t.id = doc_id"""
)
def reextracted_records(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    old = "'success' as extraction_status", "'plain' as extraction_method", "'' as extraction_error", "1L as extraction_attempts", "'2024-01-01' as extraction_timestamp", "cast(n_chars as long) as content_length", "'old' as content_hash", "'2024-01-01' as updated_at"
    stored = docs.selectExpr("doc_id as id", "text as content", *old)
    tried = docs.where("doc_id % 3 = 0").selectExpr(*_items(_TRIED[7:].split(" from ")[0]))
    again = docs.where("doc_id % 12 = 0").selectExpr("doc_id as id", "'again' as content", "'ocr' as method", "cast(null as string) as error", "9L as pos")
    out = R.reextracted(stored, tried.unionByName(again), "id", "pos", F.lit("2025-06-30"))
    return out.withColumn("content", F.sha2(F.col("content").cast("binary"), 256))


@query("select event_type, event_id, ts from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as rn from events) where rn = 1")
def last_wins(spark, sf_dir):
    return R.last_wins(table(spark, sf_dir, "events"), ["event_type"], F.col("ts"), F.col("event_id")).select("event_type", "event_id", "ts")


# ---- retrieval --------------------------------------------------------------------------------

_SCORED = """with v as (select vec_id as id, label, embedding::double[] as e, vec_id % 3 as kind, label % 4 as number_, 'text ' || (vec_id % 40) as text from embeddings),
scored as (select id, label, kind, text, case when label < 8 then 'C' || label else '' end as number, 'T' || label as title,
round(list_dot_product(e, (select e from v where id = 0)) / sqrt(list_dot_product(e, e)) / sqrt((select list_dot_product(e, e) from v where id = 0)), 6) as score from v) """


def chunks(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", (F.col("vec_id") % 3).alias("kind"), F.concat(F.lit("text "), (F.col("vec_id") % 40).cast("string")).alias("text"), F.when(F.col("label") < 8, F.concat(F.lit("C"), F.col("label").cast("string"))).otherwise("").alias("number"), F.concat(F.lit("T"), F.col("label").cast("string")).alias("title"), "embedding")


def first_vector(spark, sf_dir) -> list[float]:
    """The vector of id 0, as the question's; zeros without it."""
    row = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(row[0]) if row else [0.0] * 64


@query(_SCORED + "select id, label, score from scored where score >= 0.0 order by score desc, id limit 12")
def vector_topk(spark, sf_dir):
    return S.search(chunks(spark, sf_dir), first_vector(spark, sf_dir), 12, 0.0).select("id", "label", "score")


@query(_SCORED + "select id, label, score from scored where score >= 0.05 and label in (1, 2, 3) order by score desc, id limit 12")
def vector_topk_filtered(spark, sf_dir):
    return S.search(chunks(spark, sf_dir), first_vector(spark, sf_dir), 12, 0.05, F.col("label").isin(1, 2, 3)).select("id", "label", "score")


_WORDS = "string_split_regex(lower(d.text), '[^a-z]+')"


@query(_SCORED + f"select s.id, s.score from scored s join documents d on d.doc_id = s.id where (list_contains({_WORDS}, 'license') or (list_contains({_WORDS}, 'all') and list_contains({_WORDS}, 'rights'))) and s.score >= -1 order by s.score desc, s.id limit 12")
def keyword_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.split(F.lower("text"), "[^a-z]+").alias("tokens"))
    hits = docs.where(S.has_keywords(F.col("tokens"), ["license", "All rights"])).select("id")
    return S.search(chunks(spark, sf_dir).join(hits, "id", "left_semi"), first_vector(spark, sf_dir), 12, -1.0).select("id", "score")


@query(_SCORED + "select id, kind, round(score + case when kind = 1 then 0.1 else 0.0 end, 6) as score from (select * from scored where score >= 0.0 order by score desc, id limit 24) order by score desc, id limit 12")
def type_boost_search(spark, sf_dir):
    return S.search_by_type(chunks(spark, sf_dir).withColumn("kind", F.col("kind").cast("string")), first_vector(spark, sf_dir), "kind", ["1"], 12, 0.0).select("id", F.col("kind").cast("long").alias("kind"), "score")


_HIER = (
    _SCORED
    + """, pos as (select * from scored where score >= 0), fetched as (select * from pos order by score desc, id limit 50),
g as (select number, max(score) as best from fetched where number <> '' group by 1 order by best desc, number limit 5), r as (select *, row_number() over (order by best desc, number) as rank, count(*) over () as n, sum(best) over () as total from g),
t as (select *, (select best from r where rank = 1) as b1, coalesce((select best from r where rank = 2), 0.0) as b2, greatest(2, cast(round_even(12 * best / total, 0) as integer)) as slots from r),
a as (select number, case when b1 > 0.6 and (n = 1 or b1 > b2 * 1.2) then case when rank = 1 then greatest(12 - 2 * (n - 1), 6) else 2 end else greatest(0, least(slots, 12 - coalesce(sum(slots) over (order by rank rows between unbounded preceding and 1 preceding), 0))) end as slots from t),
w as (select id, label, kind, text, score, 0 as src from (select s.*, a.slots, row_number() over (partition by s.number order by s.score desc, s.id) as rn from pos s join a using (number)) where rn <= slots),
o as (select id, label, kind, text, score, 1 as src from (select *, dense_rank() over (order by b desc, title) as grp from (select *, max(score) over (partition by title) as b, row_number() over (partition by title order by score desc, id) as rn from fetched where number = '')) where grp <= 5 and rn <= 3),
m as (select *, row_number() over (partition by substr(text, 1, 200) order by src, score desc, id) as k from (select * from w union all select * from o))
select id, label, round(score + case when kind = 2 then 0.1 else 0.0 end, 6) as score from m where src = 0 or k = 1 order by score desc, id limit 12"""
)


@query(_HIER)
def hierarchical_search(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("kind", F.col("kind").cast("string"))
    return S.hierarchical(c, first_vector(spark, sf_dir), "number", "title", "text", 12, 5, "kind", ["2"]).select("id", "label", "score")


_LISTS = _SCORED + """, vec as (select *, row_number() over (order by score desc, id) as pos from (select * from scored where score >= 0 order by score desc, id limit 24)),
kw as (select *, row_number() over (order by score desc, id) as pos from (select * from scored where label in (4, 5) order by score desc, id limit 24)) """


def _positions(hits):
    return hits.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # a result list


@query(_LISTS + ", b as (select *, row_number() over (partition by substr(text, 1, 100) order by src, pos) as k from (select *, 0 as src from kw where pos <= 6 union all select *, 1 as src from vec)) select id, score, rank from (select *, row_number() over (order by src, pos) as rank from b where k = 1) where rank <= 12")
def hybrid_merge(spark, sf_dir):
    c, q = chunks(spark, sf_dir), first_vector(spark, sf_dir)
    out = S.hybrid_merge(_positions(S.search(c, q, 24, 0.0)), _positions(S.search(c, q, 24, -1.0, F.col("label").isin(4, 5))), "text", 12)
    return out.select("id", "score", F.col("rank").cast("long").alias("rank"))


@query(_LISTS + "select id, score from (select *, row_number() over (partition by substr(text, 1, 100) order by score desc, pos) as k from vec) where k = 1 order by score desc, pos limit 10")
def dedup_results(spark, sf_dir):
    return S.deduplicated(_positions(S.search(chunks(spark, sf_dir), first_vector(spark, sf_dir), 24, 0.0)), "text", 10).select("id", "score")


_RELEVANCE = "(label % 5) / 5.0"


@query(
    _LISTS
    + f""", d as (select id, score, round(score * (0.7 + 0.3 * coalesce(case when label <> 9 then {_RELEVANCE} end, 0.5)) * case when count(*) over (partition by title) >= 2 then 1.0 else 0.85 end, 6) as adjusted from vec),
r as (select *, row_number() over (order by adjusted desc, id) as rank, max(adjusted) over () as top from d), k as (select *, top <= 0 or adjusted >= top * 0.7 as keep, sum((top <= 0 or adjusted >= top * 0.7)::int) over () as kept from r)
select id, adjusted, rank from k where (kept >= 3 and keep) or (kept < 3 and rank <= 3)"""
)
def prune_coherence(spark, sf_dir):
    hits = S.search(chunks(spark, sf_dir), first_vector(spark, sf_dir), 24, 0.0)
    relevance = spark.range(9).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("title"), ((F.col("id") % 5) / F.lit(5.0)).alias("title_relevance"))
    return S.coherent(hits, "title", relevance).select("id", "adjusted", F.col("rank").cast("long").alias("rank"))


_AGED = "case label % 4 when 0 then '2024-06-15' when 1 then '2019-01-31' when 2 then 'unknown' else '2010-05-05' end"


@query(
    _LISTS
    + f""", one as (select *, {_AGED} as date from (select *, row_number() over (partition by title order by score desc, id) as k from vec) where k = 1),
s as (select title, id, label, round(round(score, 4) * greatest(0.7, 1.0 - coalesce(date_diff('day', try_strptime(date, '%Y-%m-%d')::date, date '2026-01-01') / 365.25, 0.0) * 0.04), 4) as score from one),
p as (select title, id, case when {_RELEVANCE} < 0.5 then round(score * (0.7 + 0.6 * {_RELEVANCE}), 4) else score end as relevance_score from s),
r as (select *, row_number() over (order by relevance_score desc, title) as rank, max(relevance_score) over () as top from p)
select title, id, relevance_score, rank from r where relevance_score >= top * 0.75 and rank <= 8"""
)
def source_ranking(spark, sf_dir):
    hits = S.search(chunks(spark, sf_dir), first_vector(spark, sf_dir), 24, 0.0).withColumn("date", F.expr(_AGED))
    out = S.ranked_sources(hits, "title", "date", "2026-01-01", relevance=F.expr("cast(label % 5 as double) / 5.0D"))
    return out.select("title", "id", "relevance_score", F.col("rank").cast("long").alias("rank"))


def flagship(spark, sf_dir):
    """Top hits by cosine, each text once, ranked."""
    hits = S.deduplicated(_positions(S.search(chunks(spark, sf_dir), first_vector(spark, sf_dir), 24, 0.0)), "text", 12)
    return _positions(hits.drop("pos")).select(F.col("pos").alias("rank"), F.col("id").alias("vec_id"), "label", "score")


@query(
    RECORDS
    + """select arg_max(title, length(title) * 10000000000 - rn) as title, arg_min(source, rn) as source, min(nullif(date, '')) as date, nullif(arg_min(coalesce(link, ''), rn), '') as link, count(*) as n,
string_agg(id::varchar, ',' order by rn) filter (where rn <= 5) as texts from (select *, row_number() over (partition by k order by id) as rn from (select *, 'N' || (id % 60) as k from records)) group by k"""
)
def circular_grouping(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("k", F.concat(F.lit("N"), (F.col("id") % 60).cast("string"))).withColumn("text", F.col("id").cast("string"))
    n = r.groupBy(F.col("k").alias("number")).agg(F.count("*").alias("n"))
    out = G.group_chunks(r, "k", "id").join(n, "number")
    return out.select("title", "source", "date", "link", "n", F.array_join("texts", ",").alias("texts"))


# ---- graph ------------------------------------------------------------------------------------

_EDGES = "edges as (select o_orderkey as src, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as dst from orders), sup as (select src, dst from edges where dst is not null)"


def supersedes(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.lag("o_orderkey").over(w).alias("dst"))
    return e.where("dst is not null")


#: A circular of each customer (chain and latest), and all of them (freshness and impact take lists).
_STARTS = "starts as (select min(o_orderkey) as node from orders group by o_custkey)"
_START = "starts as (select min(o_orderkey) as node from orders)"
_ALL = "starts as (select o_orderkey as node from orders)"


def start(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.min("o_orderkey").alias("node"))


def starts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("node")).select("node")


def every(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"))


@query(f"with recursive {_EDGES}, {_STARTS}, down(start, node) as (select node, node from starts union select d.start, s.dst from down d join sup s on s.src = d.node), up(start, node) as (select node, node from starts union select u.start, s.src from up u join sup s on s.dst = u.node) select start, node from down union select start, node from up")
def amendment_chain(spark, sf_dir):
    return G.chain(supersedes(spark, sf_dir), starts(spark, sf_dir))


@query(f"with recursive {_EDGES}, {_STARTS}, up(start, node) as (select node, node from starts union select u.start, s.src from up u join sup s on s.dst = u.node) select start, max(node) as latest from up where not exists (select 1 from sup where sup.dst = up.node) group by 1")
def latest_version(spark, sf_dir):
    nodes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_orderdate").alias("date"))
    return G.latest(supersedes(spark, sf_dir), starts(spark, sf_dir), nodes)


def _nodes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("node"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderpriority").alias("source"))


_NODES = "nodes as (select o_orderkey as node, strftime(o_orderdate, '%Y-%m-%d') as date, o_orderpriority as source from orders)"
_ABOUT = "about as (select distinct l_orderkey as src, p_brand as dst from lineitem join part on p_partkey = l_partkey)"
_APPLIES = "applies as (select distinct o_orderkey as src, n_name as dst from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey)"


def about(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("dst"))
    return table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_orderkey").alias("src")).join(part, F.col("l_partkey") == F.col("p_partkey")).select("src", "dst").distinct()


def applies_to(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("dst"))
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("src"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("src", "dst").distinct()


@query(f"with {_NODES}, {_ABOUT}, {_APPLIES}, found as (select b.src as node from about a join about b using (dst) where a.src = 1 and b.src <> 1 union select b.src from applies a join applies b using (dst) where a.src = 1 and b.src <> 1) select node, date from found join nodes using (node) order by date desc, node limit 10")
def related_circulars(spark, sf_dir):
    return G.related(1, [about(spark, sf_dir), applies_to(spark, sf_dir)], _nodes(spark, sf_dir).select("node", "date"))


@query(f"with {_EDGES}, {_ALL} select node, max(src) is null as is_latest, max(src) as superseded_by from starts join orders on o_orderkey = node left join sup on dst = node group by 1")
def freshness_check(spark, sf_dir):
    return G.freshness(every(spark, sf_dir), _nodes(spark, sf_dir), supersedes(spark, sf_dir))


@query(f"with {_ALL}, {_ABOUT}, {_APPLIES} select node, coalesce((select string_agg(dst, ',' order by dst) from applies where src = node), '') as entities, coalesce((select string_agg(dst, ',' order by dst) from about where src = node), '') as regulations from starts")
def impact_analysis(spark, sf_dir):
    return G.impact(every(spark, sf_dir), applies_to(spark, sf_dir), about(spark, sf_dir))


@query(f"with {_NODES}, {_ABOUT} select node, date, source, coalesce((select string_agg(dst, ',' order by dst) from about where src = node), '') as topics from nodes where lower(source) = '1-urgent' and date >= '1995-01-01' and date <= '1995-12-31'")
def source_summary(spark, sf_dir):
    return G.source_summary(_nodes(spark, sf_dir), about(spark, sf_dir), "1-URGENT", "1995-01-01", "1995-12-31")


@query(f"with {_NODES}, {_ABOUT} select node, date, source, rn from (select *, row_number() over (partition by source order by date desc, node) as rn from nodes where node in (select src from about where contains(lower(dst), 'brand#1'))) where rn <= 5")
def cross_source_topic(spark, sf_dir):
    return G.by_topic(_nodes(spark, sf_dir), about(spark, sf_dir), "BRAND#1", 5).select("node", "date", "source", F.col("rn").cast("long").alias("rn"))


@query(f"with {_APPLIES}, is_a as (select n_name as src, r_name as dst from nation join region on r_regionkey = n_regionkey), start as (select min(r_name) as e from region), below as (select e as dst from start union select src from is_a, start where is_a.dst = e) select src, dst from applies join below using (dst)")
def entity_descendants(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    is_a = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"))
    return G.under_entity(is_a, r.agg(F.min("r_name")).first()[0], applies_to(spark, sf_dir), None)


@query(f"with {_EDGES}, {_ABOUT}, {_APPLIES} select (select count(*) from orders) as nodes, (select count(*) from sup) as supersedes, (select count(*) from about) as about, (select count(*) from applies) as applies_to")
def graph_stats(spark, sf_dir):
    return G.stats(_nodes(spark, sf_dir), supersedes=supersedes(spark, sf_dir), about=about(spark, sf_dir), applies_to=applies_to(spark, sf_dir))


@query("select c_custkey, coalesce(r_name, c_mktsegment) as entity from customer left join region on lower(r_name) = lower(case c_custkey % 3 when 0 then c_mktsegment when 1 then 'asia' else 'EUROPE' end)")
def canonical_entity(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.expr("case c_custkey % 3 when 0 then c_mktsegment when 1 then 'asia' else 'EUROPE' end").alias("entity"))
    aliases = table(spark, sf_dir, "region").select(F.col("r_name").alias("alias"), F.col("r_name").alias("canonical"))
    return G.canonical(names, "entity", aliases).select("c_custkey", "entity")


_CITED = "concat('x ', case doc_id % 4 when 0 then 'supersedes circular RBI/2023-2024/' when 1 then 'SEBI/2022-23/5 is hereby withdrawn from ' when 2 then 'earlier circular no. RBI/2021-22/' else 'see RBI/2020-21/' end, cast(doc_id as string), ' of the date')"


@query("select 'N' || doc_id as number, case doc_id % 4 when 0 then 'RBI/2023-24/' || doc_id when 1 then 'SEBI/2022-23/5' else 'RBI/2021-22/' || doc_id end as ref from documents where doc_id % 4 < 3")
def superseded_references(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("N"), F.col("doc_id").cast("string")).alias("number"), F.concat_ws(" ", "text", F.expr(_CITED), "text").alias("text"))
    return C.superseded(docs)


# ---- sections and chunks ----------------------------------------------------------------------

_LINES = "lines as (select conv_id, turn, role, len(string_split_regex(trim(text), '\\s+')) as tokens, case when role = 'user' then turn || '. ' || text else text end as line from conversations)"


def lines(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    text = F.when(F.col("role") == "user", F.concat(F.col("turn").cast("string"), F.lit(". "), F.col("text"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", "role", F.size(F.split(F.trim("text"), r"\s+")).cast("long").alias("tokens"), text.alias("line"))


@query(f"with {_LINES}, cut as (select *, sum((role = 'user')::int) over (partition by conv_id order by turn) as section from lines) select conv_id, cast(section as bigint) as section, count(*) as n_lines, min(turn) as first_turn from cut group by 1, 2")
def section_split(spark, sf_dir):
    cut = C.islands(lines(spark, sf_dir), "conv_id", "turn", F.coalesce(C.heading_of(F.col("line"))["level"] == 1, F.lit(False)) & (F.col("role") == "user"))
    return cut.groupBy("conv_id", F.col("section").cast("long").alias("section")).agg(F.count("*").alias("n_lines"), F.min("turn").alias("first_turn"))


@query(f"with {_LINES}, m as (select *, sum((tokens >= 50 or rn = 1)::int) over (partition by conv_id order by turn) as merged from (select *, row_number() over (partition by conv_id order by turn) as rn from lines)) select conv_id, cast(merged as bigint) as merged, count(*) as n, cast(sum(tokens) as bigint) as tokens from m group by 1, 2")
def short_section_merge(spark, sf_dir):
    m = C.merge_short(lines(spark, sf_dir), "conv_id", "turn", "tokens")
    return m.groupBy("conv_id", F.col("merged").cast("long").alias("merged")).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


@query()
def chunk_document(spark, sf_dir):
    return C.chunks(table(spark, sf_dir, "documents"), 100, 80, 140, 10).select("doc_id", "chunk_index", "total_chunks", "token_count", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


_ACT = "concat('Preamble.\n', 'Section 1. Short title —\n', text, '\nSection 2. Scope —\n', text, '\nSCHEDULE A ', source)"


@query(
    """select doc_id, part, title, sha256(rtrim(content, chr(10) || chr(9) || chr(13) || ' ')) as content from (
select doc_id, '1' as part, 'Short title' as title, 'Section 1. Short title —' || chr(10) || text as content from documents
union all select doc_id, '2', 'Scope', 'Section 2. Scope —' || chr(10) || text from documents union all select doc_id, 'SCHEDULES', 'Schedules', 'SCHEDULE A ' || source from documents)"""
)
def legislation_parts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_ACT).alias("text"))
    return C.split_parts(docs, "act").select("doc_id", "part", "title", F.sha2(F.col("content").cast("binary"), 256).alias("content"))


@query()
def html_extract(spark, sf_dir):
    return H.extract(table(spark, sf_dir, "pages")).select("page_id", "title", F.sha2(F.col("content").cast("binary"), 256).alias("content_sha256"), "n_links", F.size("pdf_links").alias("n_pdfs"))


@query("select page_id, cast(len(regexp_extract_all(html, '<a\\s[^>]*href=')) as integer) as n_links from pages")
def html_links(spark, sf_dir):
    return H.extract(table(spark, sf_dir, "pages")).select("page_id", "n_links")


@query()
def html_listing(spark, sf_dir):
    return H.listing(table(spark, sf_dir, "pages"))


# ---- evaluation and streams -------------------------------------------------------------------

_SCORES = "scores as (select doc_id as question, b.baseline, c.criterion, greatest(1, least(5, cast((doc_id * (c.criterion + 2) + ascii(b.baseline)) % 7 as integer))) as score from labels, (values ('rag'), ('gpt'), ('custom')) as b(baseline), (values (0), (1), (2), (3), (4)) as c(criterion) where baseline <> 'custom' or doc_id % 2 = 0), av as (select question, baseline, round(avg(score), 2) as average from scores group by 1, 2)"


def scores(spark, sf_dir):
    one = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("question"), F.explode(F.array(*map(F.lit, ("rag", "gpt", "custom")))).alias("baseline"))
    long = one.select("question", "baseline", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("criterion")).where("baseline <> 'custom' or question % 2 = 0")
    return long.withColumn("score", E.clamped(((F.col("question") * (F.col("criterion") + 2) + F.ascii("baseline")) % 7).cast("int")))


@query(f"with {_SCORES}, m as (select baseline, count(*) as questions, round(avg(average), 2) as m from av group by 1) select baseline, questions, m as mean, round((select m from m where baseline = 'rag') - m, 2) as advantage from m")
def eval_summary(spark, sf_dir):
    return E.summary(scores(spark, sf_dir), "rag")


@query(f"with {_SCORES} select a.question, a.baseline, a.average, round(o.average - a.average, 2) as advantage from av a left join av o on o.question = a.question and o.baseline = 'rag'")
def eval_questions(spark, sf_dir):
    return E.compared(scores(spark, sf_dir), "rag")


@query(f"with {_SCORES} select baseline, criterion, round(avg(score), 2) as mean from scores group by 1, 2")
def criterion_means(spark, sf_dir):
    return E.criterion_means(scores(spark, sf_dir))


@query(f"with {_SCORES} select o.baseline, count(*) filter (where r.average > o.average) as wins, count(*) filter (where r.average < o.average) as losses, count(*) filter (where r.average = o.average) as ties from av o join av r on r.question = o.question and r.baseline = 'rag' where o.baseline <> 'rag' group by 1")
def win_loss_tie(spark, sf_dir):
    return E.wins(scores(spark, sf_dir), "rag")


@query(f"with {_SCORES} select case when average >= 4 then 'OK' when average >= 3 then 'WEAK' else 'FAIL' end as band, count(*) as cnt, count(*) filter (where average >= 4.5) as excellent from av where baseline = 'rag' group by 1")
def quality_bands(spark, sf_dir):
    return E.bands(scores(spark, sf_dir), "rag")


@query(
    """with v as (select vec_id, label, embedding::double[] as e from embeddings), q as (select vec_id as question, label as expected, e from v where vec_id % 50 = 0),
s as (select question, expected, vec_id, label, round(list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(v.e, v.e)), 6) as score from q, v where vec_id <> question),
h as (select * from (select *, row_number() over (partition by question order by score desc, vec_id) as rn from s) where rn <= 10)
select question, count(*) as hits, count(*) filter (where label = expected) as correct, round(100.0 * count(*) filter (where label <> expected) / count(*), 1) as issue_rate, round(max(score) - min(score), 6) as drop_off,
case when 100.0 * count(*) filter (where label <> expected) / count(*) < 25 then 'LOW' when 100.0 * count(*) filter (where label <> expected) / count(*) < 50 then 'MEDIUM' else 'HIGH' end as severity,
round(100.0 * count(*) filter (where label = expected) / count(*), 1) as correct_pct, count(distinct label) as sources, round(100.0 * max(same) / count(*), 1) as main_share, round(avg(score), 4) as context_score, max(vec_id % 20) - min(vec_id % 20) as year_spread
from (select *, count(*) over (partition by question, label) as same from h) group by 1"""
)
def retrieval_diagnosis(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    asked = e.where("id % 50 = 0").select(F.col("id").alias("question"), F.col("label").alias("expected"), "embedding")
    hits = S.search_many(e, asked.select("question", "embedding"), 11).where("id <> question")
    w = Window.partitionBy("question").orderBy(F.desc("score"), "id")
    hits = hits.withColumn("rn", F.row_number().over(w)).where("rn <= 10")
    return E.diagnosis(hits.join(asked.drop("embedding"), "question").join(e.select("id", "label", (F.col("id") % 20).alias("year")), "id"), "expected", "label", "year")


@query("select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc, role desc, text desc) as rn from conversations) where rn <= 2")
def last_turns(spark, sf_dir):
    return E.last_turns(table(spark, sf_dir, "conversations"), 2).select("conv_id", "turn", "role")


@query("""with e as (select user_id, event_id, (event_type = 'error')::int as bad from events), o as (select *, sum(1 - bad) over (partition by user_id order by event_id) as ok from e),
s as (select *, sum(bad) over (partition by user_id, ok order by event_id) as streak from o), t as (select *, coalesce(max((streak >= 2)::int) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as stop from s)
select user_id, count(*) as seen, cast(max(streak) as integer) as worst from t where stop = 0 group by 1""")
def failure_breaker(spark, sf_dir):
    rows = E.breaker(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "error", 2)
    return rows.groupBy("user_id").agg(F.count("*").alias("seen"), F.max("streak").alias("worst"))


@query("select source from documents where lang = 'en' except select source from documents where lang = 'es' and n_chars > 3000")
def source_diff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.where("lang = 'en'").select("source").subtract(docs.where("lang = 'es' and n_chars > 3000").select("source"))


@query("select event_type, count(*) as cnt, cast(sum(count(*)) over (order by event_type) as bigint) as total from events group by 1")
def crawl_progress_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return P.progress(spark, f"{sf_dir}/events.parquet", "*.parquet", schema, "event_type")


# ---- connectors and composites ----------------------------------------------------------------

_GAZETTE = "case doc_id % 4 when 0 then concat('CG-DL-E-16022026-', cast(doc_id as varchar(9))) when 1 then 'CG-2702' when 2 then 'A-B-CDEF-7' else concat('X-05012019-', cast(doc_id as varchar(9))) end"
_MEETING = "concat(cast(doc_id % 60 as varchar(9)), case doc_id % 3 when 0 then 'th' when 1 then ' ST' else '' end, ' Meeting')"
_WRITTEN = "case doc_id % 4 when 0 then concat(cast(doc_id % 28 + 1 as varchar(9)), 'th August 2023') when 1 then 'June 7, 2022 at noon' when 2 then '28th & 29th march 2021' else 'soon' end"
_TITLED = "concat(source, ' notice (', cast(doc_id % 9 as varchar(9)), '.5 MB) ')"


@query(
    rf"""select doc_id, case when len(string_split(g, '-')) >= 3 and regexp_matches(right(string_split(g, '-')[-2], 4), '^[0-9]{{4}}$') then 'https://e/WriteReadData/' || right(string_split(g, '-')[-2], 4) || '/' || string_split(g, '-')[-1] || '.pdf' else '' end as gazette,
case when regexp_extract(m, '(?i)(\d+)\s*(?:st|nd|rd|th)', 1) <> '' then 'GST-COUNCIL-' || regexp_extract(m, '(?i)(\d+)\s*(?:st|nd|rd|th)', 1) else '' end as meeting,
case doc_id % 4 when 0 then '2023-08-' || lpad(cast(doc_id % 28 + 1 as varchar), 2, '0') when 1 then '2022-06-07' when 2 then '2021-03-29' else '' end as date,
trim(regexp_replace(t, '\(\d+(?:\.\d+)?\s*[KMG]?B\)\s*$', '')) as title, case when doc_id % 2 = 0 then doc_id || '/2024' else doc_id || '/2023-24' end as number
from (select doc_id, {_GAZETTE} as g, {_MEETING} as m, {_TITLED} as t from documents)"""
)
def connector_fields(spark, sf_dir):
    fix = lambda sql: F.expr(sql.replace("varchar(9)", "string"))
    docs = table(spark, sf_dir, "documents")
    number = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 1, "/2023-24").otherwise(""))
    year = F.when(F.col("doc_id") % 2 == 1, "2023-24").otherwise("2024")
    return docs.select("doc_id", N.gazette_url(fix(_GAZETTE), "https://e").alias("gazette"), N.meeting_number(fix(_MEETING)).alias("meeting"), N.written_date(fix(_WRITTEN)).alias("date"), N.without_size(fix(_TITLED)).alias("title"), N.trade_number(number, year).alias("number"))


@query("select conv_id, string_agg(chr(10) || turn || ': ' || text, '' order by turn, role, text) as block from (select *, row_number() over (partition by conv_id order by turn desc, role desc, text desc) as rn from conversations) where rn <= 10 group by 1")
def conversation_context(spark, sf_dir):
    c = E.last_turns(table(spark, sf_dir, "conversations"), 10)
    part = F.concat(F.lit("\n"), F.col("turn").cast("string"), F.lit(": "), F.col("text"))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", part.alias("p")))), lambda x: x["p"]), "").alias("block"))


@query()
def index_records(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("file_name", F.col("crawler"))
    return AS.index(r).select("doc_id", "chunk_index", "id", "kind", F.size("embedding").alias("dim"))


def asked_chunks(spark, sf_dir):
    """Embeddings as chunks of circulars that are named, so that a question can name one."""
    return chunks(spark, sf_dir).withColumn("source", F.lit("rbi")).withColumn("kind", F.lit("rule")).withColumn("number", F.expr("concat('RBI/2023-24/', label)")).withColumn("chunk_index", F.expr("cast(1000000 - id as int)"))


_ASKED_SCORES = """with v as (select vec_id as id, label, embedding::double[] as e from embeddings), q as (select e from v where id = (select min(vec_id) from embeddings)),
s as (select id, label, round(list_dot_product(v.e, q.e) / sqrt(list_dot_product(v.e, v.e)) / sqrt(list_dot_product(q.e, q.e)), 6) as score from v, q)"""


@query(_ASKED_SCORES + " select cast(row_number() over (order by score desc, id) as integer) as rank, id, score from (select * from s where label = 3 and score >= 0 order by score desc, id limit 12)")
def ask_named_circular(spark, sf_dir):
    return AS.ask(asked_chunks(spark, sf_dir), AS.planned(spark, "Which requirement for lending by lenders of any size and kind follows from RBI/2023-24/3?"), first_vector(spark, sf_dir)).select("rank", "id", "score")


@query(_ASKED_SCORES + " select cast(row_number() over (order by 1000000 - id, id) as integer) as rank, id, score from (select * from s where label = 3 and score >= 0 order by score desc, id limit 50)")
def ask_analysis(spark, sf_dir):
    return AS.ask(asked_chunks(spark, sf_dir), AS.planned(spark, "Explain RBI/2023-24/3"), first_vector(spark, sf_dir)).select("rank", "id", "score")


@query(
    _ASKED_SCORES
    + """, pos as (select *, 'RBI/2023-24/' || label as number, 'text ' || (id % 40) as text from s where score >= 0), fetched as (select * from pos order by score desc, id limit 50),
g as (select number, max(score) as best from fetched group by 1 order by best desc, number limit 5), r as (select *, row_number() over (order by best desc, number) as rank, count(*) over () as n, sum(best) over () as total from g),
t as (select *, (select best from r where rank = 1) as b1, coalesce((select best from r where rank = 2), 0.0) as b2, greatest(2, cast(round_even(12 * best / total, 0) as integer)) as slots from r),
a as (select number, case when b1 > 0.6 and (n = 1 or b1 > b2 * 1.2) then case when rank = 1 then greatest(12 - 2 * (n - 1), 6) else 2 end else greatest(0, least(slots, 12 - coalesce(sum(slots) over (order by rank rows between unbounded preceding and 1 preceding), 0))) end as slots from t),
w as (select id, text, round(score + 0.1, 6) as score from (select s.*, a.slots, row_number() over (partition by s.number order by s.score desc, s.id) as rn from pos s join a using (number)) where rn <= slots order by score desc, id limit 12),
d as (select *, row_number() over (partition by text order by score desc, id) as k from w)
select cast(row_number() over (order by score desc, id) as integer) as rank, id, score from d where k = 1"""
)
def ask_question(spark, sf_dir):
    return AS.ask(asked_chunks(spark, sf_dir), AS.planned(spark, "Which requirement applies to NBFC lending?"), first_vector(spark, sf_dir)).select("rank", "id", "score")


def titled_nodes(spark, sf_dir):
    return _nodes(spark, sf_dir).withColumn("title", F.concat(F.lit("Order "), F.col("node").cast("string")))


def graph_edges(spark, sf_dir):
    return {"supersedes": supersedes(spark, sf_dir), "about": about(spark, sf_dir), "applies_to": applies_to(spark, sf_dir), "amends": about(spark, sf_dir)}


_TITLED_NODES = _NODES + ", t as (select node, date, source, 'Order ' || node as title from nodes)"


@query(
    f"""with recursive {_EDGES}, {_START}, {_TITLED_NODES}, {_ABOUT}, {_APPLIES}, one as (select node from starts),
down(node) as (select node from one union select s.dst from down d join sup s on s.src = d.node), up(node) as (select node from one union select s.src from up u join sup s on s.dst = u.node),
c as (select t.* from (select node from down union select node from up) join t using (node)), newest as (select * from c where node not in (select dst from sup) order by date desc, node desc limit 1),
above as (select t.* from up join t using (node) where node not in (select dst from sup) order by date desc, node desc limit 1),
rel as (select node, title, source, date from (select b.src as node from about a join about b using (dst), one where a.src = one.node and b.src <> one.node union select b.src from applies a join applies b using (dst), one where a.src = one.node and b.src <> one.node) join t using (node) order by date desc, node limit 10)
select 'chain' as intent, 1 as pos, '[AMENDMENT CHAIN: ' || string_agg(node || ' (' || date || ')', ' → ' order by date, node) || ']' as line from c
union all select 'chain', 2, '[LATEST VERSION: ' || node || ' — ' || title || ']' from newest
union all select 'latest', 1, '[NOTE: ' || one.node || ' has been superseded. Latest version: ' || above.node || ' — ' || title || ']' from above, one where above.node <> one.node
union all select 'impact', 1, '[APPLIES TO: ' || string_agg(dst, ', ' order by dst) || ']' from applies, one where src = node having count(*) > 0
union all select 'impact', 2, '[AMENDS: ' || string_agg(dst, ', ' order by dst) || ']' from about, one where src = node having count(*) > 0
union all select 'related', 0, '[RELATED CIRCULARS for ' || node || ']' from one where exists (select 1 from rel)
union all select 'related', cast(row_number() over (order by date desc, node) as integer), '- ' || node || ': ' || title || ' (' || source || ', ' || date || ')' from rel
union all select 'summary', 0, '[CIRCULARS FROM 1-URGENT]'
union all select 'summary', cast(row_number() over (order by date desc, node) as integer), '- ' || node || ': ' || title || ' (' || date || ')' from (select * from t where source = '1-URGENT' order by date desc, node limit 15)
union all select 'cross_reference', 0, '[CROSS-REGULATOR VIEW: BRAND#1]'
union all select 'cross_reference', cast(row_number() over (order by source, rn) as integer), line from (select source, rn, '  - ' || node || ': ' || title || ' (' || date || ')' as line from (select *, row_number() over (partition by source order by date desc, node) as rn from t where node in (select src from about where contains(lower(dst), 'brand#1'))) where rn <= 5 union all select distinct source, 0, chr(10) || '  ' || source || ':' from t where node in (select src from about where contains(lower(dst), 'brand#1')))"""
)
def graph_context(spark, sf_dir):
    nodes, one = titled_nodes(spark, sf_dir), start(spark, sf_dir).first()[0]
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("dst"))
    named = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_orderkey").alias("src")).join(part, F.col("l_partkey") == F.col("p_partkey")).select("src", "dst")
    edges = {"supersedes": P.written(supersedes(spark, sf_dir)), "about": P.written(named), "applies_to": P.written(applies_to(spark, sf_dir))}  # once for all branches
    edges["amends"] = edges["about"]
    walk = G.walked(edges["supersedes"], start(spark, sf_dir))
    of = lambda intent: AN.graph_lines(intent, nodes, edges, one, "1-urgent", "BRAND#1", walk).select(F.lit(intent).alias("intent"), "pos", "line")
    out = of("chain")
    for intent in ("latest", "impact", "related", "summary", "cross_reference"):
        out = out.unionByName(of(intent))
    return out


@query(f"with {_EDGES} select o_orderkey as number, o_totalprice as score, 'Superseded by ' || max(src) as freshness_note from orders left join sup on dst = o_orderkey group by 1, 2")
def freshness_notes(spark, sf_dir):
    hits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("number"), F.col("o_totalprice").alias("score"))
    return AN.annotated(hits, "number", supersedes(spark, sf_dir)).select("number", "score", "freshness_note")


_HIT = "select cast(doc_id as integer) as rank, upper(lang) as source, case when doc_id % 3 = 0 then '' else 'N' || doc_id end as number, source as title, case when doc_id % 2 = 0 then '2024-01-01' end as date, '' as link, case when doc_id % 4 = 0 then 'general' else 'rule' end as kind, cast(doc_id % 5 as integer) as chunk_index, cast(doc_id % 5 + doc_id % 2 as integer) as total_chunks, n_chars / 1000.0 as score, text from documents"


@query(
    f"""with h as ({_HIT}) select rank, sha256('[' || rank || '] Source: ' || source || case when number <> '' then ' | Circular No: ' || number else '' end || ' | Title: ' || title || case when date <> '' then ' | Date: ' || date else '' end
|| case when kind <> 'general' then ' | Type: ' || kind else '' end || case when total_chunks > 1 then ' | Part ' || (chunk_index + 1) || ' of ' || total_chunks else '' end || chr(10) || text) as block,
case when rank <= 12 then '[Source ' || rank || '] ' || source || ' — ' || title || ' (Circular: ' || number || ')' || chr(10) || 'Content: ' || substr(text, 1, 1200) end as judged from h"""
)
def context_blocks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    h = d.selectExpr("cast(doc_id as int) as rank", "upper(lang) as source", "case when doc_id % 3 = 0 then '' else concat('N', doc_id) end as number", "source as title", "case when doc_id % 2 = 0 then '2024-01-01' end as date", "'' as link", "case when doc_id % 4 = 0 then 'general' else 'rule' end as kind", "cast(doc_id % 5 as int) as chunk_index", "cast(doc_id % 5 + doc_id % 2 as int) as total_chunks", "cast(null as string) as score", "text")
    judged = AN.judge_sources(h.withColumn("score", F.lit("0"))).select("rank", F.replace("block", F.lit(", Relevance: 0"), F.lit("")).alias("judged"))
    return AN.context_blocks(h).select("rank", F.sha2(F.col("block").cast("binary"), 256).alias("block")).join(judged, "rank", "left")


@query("select a.doc_id as one, b.item_id as other from (select *, row_number() over (order by doc_id) as pos from documents) a join (select *, row_number() over (order by item_id) as pos from benchmark) b using (pos)")
def zipped_results(spark, sf_dir):
    pos = lambda t, key: table(spark, sf_dir, t).select(key, F.row_number().over(Window.orderBy(key)).alias("pos"))
    return AN.zipped(pos("documents", "doc_id"), pos("benchmark", "item_id")).select(F.col("doc_id").alias("one"), F.col("item_id").alias("other"))


@query("select doc_id, doc_id % 2 = 0 as analysis from documents")
def analysis_mode(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    q = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Explain RBI/2023-24/"), F.col("doc_id").cast("string"), F.lit("?"))).otherwise(F.concat(F.lit("RBI/2023-24/"), F.col("doc_id").cast("string"), F.lit(": "), F.concat(F.lit("what must every bank of ten branches do"), F.col("text"))))
    return d.select("doc_id", AN.wants_analysis(q, T.question_number(q)).alias("analysis"))


_GRAPH_TEXT = "concat(" + _CITED + ", '. This applies to banks. It amends the Companies Act. ', text)"
_GRAPH_TOPICS = " union all ".join(f"select number, '{n}' as topic, {i} as pos, {_count_sql('t', ws)} as cnt from d" for i, (n, ws) in enumerate(TAXONOMY.items()))


@query(
    f"""with d as (select doc_id, 'N' || doc_id as number, lower(source || ' ' || substr({_GRAPH_TEXT.replace("cast(doc_id as string)", "cast(doc_id as varchar)")}, 1, 2000)) as t from documents)
select 'circulars' as kind, number as src, '' as dst from d union all select 'applies_to', number, 'Bank' from d union all select 'amends', number, 'Companies Act' from d
union all select 'supersedes', number, case doc_id % 4 when 0 then 'RBI/2023-24/' || doc_id when 1 then 'SEBI/2022-23/5' else 'RBI/2021-22/' || doc_id end from d where doc_id % 4 < 3
union all select 'about', number, topic from (select *, row_number() over (partition by number order by cnt desc, pos) as rn from ({_GRAPH_TOPICS}) where cnt >= 2) where rn <= 3"""
)
def graph_from_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("N"), F.col("doc_id").cast("string")).alias("number"), F.col("source").alias("title"), F.lit("").alias("date"), "source", F.lit("").alias("link"), F.expr(_GRAPH_TEXT).alias("text"), F.lit(0).alias("pos"))
    aliases = spark.sql("select 'Banks' as alias, 'Bank' as canonical")
    g = AS.graph_from_chunks(docs, TAXONOMY, ("Banks",), aliases)
    out = g["circulars"].select(F.lit("circulars").alias("kind"), F.col("number").alias("src"), F.lit("").alias("dst"))
    for kind in ("about", "applies_to", "amends", "supersedes"):
        out = out.unionByName(g[kind].select(F.lit(kind).alias("kind"), "src", "dst"))
    return out


_DOMAIN_ROWS = " union all ".join(f"select item_id, '{s}' as source from q where " + " or ".join("contains(lower(q), '{}')".format(w.replace("'", "''")) for w in ws) for ws, ss in V.DOMAINS.values() for s in ss)
_ASKED = "case item_id % 5 when 0 then 'We are a Type 2 NBFC. Which KYC rule applies to us? And what of customs duty?' when 1 then 'What is the ITC limit under rule 36?' when 2 then 'as an importer, is a bill of entry needed?' when 3 then 'insider trading norms of SEBI' else 'Nothing of note' end"


@query(f"with q as (select item_id, text || ' ' || {_ASKED} || ' ' || text as q from benchmark) select item_id, string_agg(distinct source, ',' order by source) as sources from ({_DOMAIN_ROWS}) group by 1")
def domain_detect(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select("item_id", F.concat_ws(" ", "text", F.expr(_ASKED), "text").alias("q"))
    return q.select("item_id", F.array_join(T.domain_sources(F.col("q")), ",").alias("sources")).where("sources is not null")


@query(f"with q as (select item_id, text || ' ' || {_ASKED} || ' ' || text as q from benchmark) select item_id, nullif(trim(regexp_extract(q, '{V.ASKER.replace(chr(39), chr(39) * 2)}', 1)), '') as asker, case when len(list_filter(string_split(q, '?'), lambda p: length(trim(p)) > 10)) > 0 and contains(q, '?') then len(list_filter(string_split(q, '?'), lambda p: length(trim(p)) > 10)) else 1 end as parts from q")
def question_parts(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select("item_id", F.concat_ws(" ", "text", F.expr(_ASKED), "text").alias("q"))
    return q.select("item_id", T.asker(F.col("q")).alias("asker"), F.size(T.sub_questions(F.col("q"))).cast("long").alias("parts"))


@query(RECORDS + ", u as (select id, concat('new ', title) as content, concat('N', cast(id as varchar(9))) as number from records where n_chars > 2000) select r.id, sha256(coalesce(u.content, r.content)) as content, case when u.id is not null then coalesce(nullif(r.number, ''), u.number) else r.number end as number, case when u.id is not null then greatest(r.id % 2, 1) else r.id % 2 end as attempts from records r left join u using (id)")
def content_update(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("attempts", F.col("id") % 2)
    u = r.where("n_chars > 2000").select("id", F.concat(F.lit("new "), "title").alias("content"), F.concat(F.lit("N"), F.col("id").cast("string")).alias("number"))
    out = R.update_content(r.select("id", "content", "number", "attempts"), u, "id")
    return out.select("id", F.sha2(F.col("content").cast("binary"), 256).alias("content"), "number", F.col("attempts").cast("long").alias("attempts"))


@query("select event_id, event_type = 'click' or (event_type in ('error', 'view') and value > 50) as resolved, 1 + (event_type in ('error', 'view'))::int as attempts from events")
def dlq_resolve(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    failures = e.select("event_id", (F.col("event_type") == "click").alias("resolved"), F.lit(1).alias("attempts"))
    done = e.where(F.col("event_type").isin("error", "view")).select("event_id", (F.col("value") > 50).alias("ok"))
    return R.resolved(failures, done, "event_id").select("event_id", "resolved", "attempts")


@query("select doc_id, (select max(item_id) from benchmark) + row_number() over (order by doc_id) as item_id from documents where lang = 'fr'")
def insert_with_ids(spark, sf_dir):
    new = table(spark, sf_dir, "documents").where("lang = 'fr'").select("doc_id")
    return R.with_ids(table(spark, sf_dir, "benchmark"), new, "item_id", "doc_id").select("doc_id", "item_id")


@query("select count(*) as records, count(*) filter (where text <> '') as with_content, string_agg(distinct source, ',' order by source) as sources from documents")
def index_summary(spark, sf_dir):
    return R.index_summary(table(spark, sf_dir, "documents"), "text", "source")


@query("select event_type, count(*) as cnt from events group by 1 order by cnt desc, event_type limit 3")
def most_common(spark, sf_dir):
    return R.most_common(table(spark, sf_dir, "events"), "event_type", 3)


@query(
    """with c as (select 'u' || (user_id % 700) as chunk_id, event_id, value, event_id % 2 as half from events), old as (select chunk_id, arg_max(value, event_id) as value from c where half = 0 group by 1), new as (select chunk_id, arg_max(value, event_id) as value from c where half = 1 and chunk_id <> 'u3' group by 1)
select chunk_id, cast(('0x' || substr(sha256(chunk_id), 1, 15)) as bigint) as id, value from (select * from new union all select * from old where chunk_id not in (select chunk_id from new))"""
)
def vector_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 700).cast("string")).alias("chunk_id"), "value", "event_id")
    stored = SK.upsert_vectors(None, c.where("event_id % 2 = 0"), "event_id")
    return SK.upsert_vectors(stored, c.where("event_id % 2 = 1 and chunk_id <> 'u3'"), "event_id").select("chunk_id", "id", "value")


@query(f"with {_EDGES}, {_APPLIES} select src || '' as src, dst || '' as dst from sup union select src || '', dst from applies")
def graph_merge(spark, sf_dir):
    text = lambda e: e.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    again = text(supersedes(spark, sf_dir)).unionByName(text(applies_to(spark, sf_dir)))
    return SK.merge_edges(text(supersedes(spark, sf_dir)), again.unionByName(spark.sql("select '' as src, 'x' as dst union all select null, 'y'")))


@query(
    """select 'rbi' as source, 'Circular ' || doc_id || ' on ' || source as title, case when doc_id % 2 = 0 then '5 Feb 2024' else 'March 1, 2023' end as date, case when doc_id % 4 = 0 then '' else 'RBI/2023-24/' || doc_id end as number, 'https://bank/n/' || doc_id as link from documents
union all select 'sebi', upper(lang) || ' ' || doc_id, 'd', case when doc_id % 3 = 0 then '' else 'S/' || doc_id end, 'https://m/' || doc_id from documents
union all select 'mca', 'Rule ' || doc_id, '', '', 'https://c/content/dms?doc=a+' || doc_id || '%2Fb' from documents where doc_id % 2 = 0
union all select 'cbdt', 'On ' || source, '1-2-24', doc_id || '/24', 'l' || doc_id from documents"""
)
def connector_records(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("i", F.col("doc_id").cast("string"))
    cut = lambda df: df.select("source", "title", "date", F.col("circular_number").alias("number"), "link")
    detail = F.concat_ws("\n", F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("RBI/2023-24/"), "i")), F.when(F.col("doc_id") % 2 == 1, "March 1, 2023"), "text")
    title = F.concat(F.lit("Circular "), "i", F.lit(" on "), "source")
    bank = N.bank_circulars(d.select(F.array(F.when(F.col("doc_id") % 2 == 0, "5 Feb 2024").otherwise("-"), title).alias("cells"), F.concat(F.lit("/n/"), "i").alias("href"), detail.alias("html_text"), F.lit("p").alias("pdf_text")), "https://bank")
    number = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("Circular No. : S/"), "i"))
    market = N.market_circulars(d.select(F.concat(F.lit(" "), F.upper("lang"), F.lit(" "), "i").alias("title"), F.lit("d").alias("date"), number.alias("number_text"), F.concat(F.lit("https://m/"), "i").alias("href"), F.lit("v?file=x.pdf").alias("frame")))
    item = F.struct(F.concat(F.lit("a "), "i", F.lit("/b")).alias("docID"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Rule "), "i")).otherwise(" ").alias("docName"))
    company = N.company_circulars(d.select(F.to_json(F.struct(F.to_json(F.array(item)).alias("documentDetails"))).alias("body")), "https://c").withColumn("circular_number", F.lit(""))
    rows = d.select(F.concat("i", F.lit("/24 - On "), "source", F.lit(" 1-2-24")).alias("text"), F.concat("i", F.lit("/24")).alias("number"), F.lit("1-2-24").alias("date"), F.concat(F.lit("l"), "i").alias("link"), F.lit(0).alias("pos"))
    tax = N.direct_tax_circulars(rows.unionByName(rows.withColumn("pos", F.lit(1)).withColumn("text", F.lit("again"))))
    return cut(bank).unionByName(cut(market)).unionByName(cut(company)).unionByName(cut(tax))


@query("select doc_id, case when doc_id % 3 = 0 then 'a.pdf,b.pdf' when doc_id % 3 = 1 then 'a.pdf,b.pdf,' || source || '.pdf' else 'a.pdf,b.pdf' end as links from documents")
def attachment_union(spark, sf_dir):
    single = F.expr("case doc_id % 3 when 0 then 'b.pdf' when 1 then concat(source, '.pdf') else '' end")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.all_attachments(F.array(F.lit("a.pdf"), F.lit("b.pdf")), single), ",").alias("links"))


# ---- indexes and tables in buckets --------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    """A new folder for a table that a query makes."""
    return f"{P.shared_folder(spark)}/tables/{uuid.uuid4().hex}"


def keyword_index(spark, sf_dir) -> K.KeywordIndex:
    """An index of all documents, made in two updates: the first has other texts for a third of the links."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("https://example.org/"), (F.col("doc_id") % 500).cast("string")).alias("link"), "text")
    replaced = F.col("id") % 500 % 3 == 0
    index = K.KeywordIndex(spark, _folder(spark), 16)
    index.update(docs.withColumn("text", F.when(replaced, F.concat_ws(" ", F.lit("all rights license"), F.reverse("text"))).otherwise(F.col("text"))), 1)
    index.update(docs.where(replaced), 2)
    return index


_INDEX_WORDS = "string_split_regex(lower(d.text), '[^a-z0-9]+')"


@query(_SCORED + f"select s.id, s.score from scored s join documents d on d.doc_id = s.id where (list_contains({_INDEX_WORDS}, 'license') or (list_contains({_INDEX_WORDS}, 'all') and list_contains({_INDEX_WORDS}, 'rights'))) and s.score >= -1 order by s.score desc, s.id limit 12")
def keyword_index_search(spark, sf_dir):
    hits = keyword_index(spark, sf_dir).matching(["license", "All rights"])
    return S.search(chunks(spark, sf_dir).join(hits, "id", "left_semi"), first_vector(spark, sf_dir), 12, -1.0).select("id", "score")


#: Frequent words, rare ones, and some that the index does not hold.
_LOOKED_UP = ("the", "license", "rights", "copyright", "token", "the", "a", "nosuchword", "incomprehensibilitiesofwords")


@query(f"select word as term, count(*) as documents from (select distinct doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) as word from documents) where word in {_LOOKED_UP!r} and length(word) between 2 and 20 group by 1")
def term_frequencies(spark, sf_dir):
    return keyword_index(spark, sf_dir).frequencies(list(_LOOKED_UP))


def vector_index(spark, sf_dir) -> VI.VectorIndex:
    """An index of all embeddings, made of other vectors for every fifth one, which are then replaced."""
    points = chunks(spark, sf_dir).select("id", "embedding", "label", "kind")
    index = VI.VectorIndex(spark, _folder(spark), "label int, kind long", 32)
    index.build(points.withColumn("embedding", F.when(F.col("id") % 5 == 1, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding"))))
    index.upsert(points.where("id % 5 = 1"), 1)
    return index


_FEW = (0, 7, 101, 250, 499)


@query(f"""with v as (select vec_id as id, label, embedding::double[] as e from embeddings), q as (select id as question, e as f from v where id in {_FEW!r}),
s as (select question, id, label, round(list_dot_product(e, f) / sqrt(list_dot_product(e, e)) / sqrt(list_dot_product(f, f)), 6) as score from v, q)
select question, id, label, score from s where score >= 0.1 qualify row_number() over (partition by question order by score desc, id) <= 10""")
def vector_index_search(spark, sf_dir):
    index, out = vector_index(spark, sf_dir), None
    for row in table(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(*_FEW)).orderBy("vec_id").collect():  # five questions
        hits = index.search(list(row["embedding"]), 10, 0.1).select(F.lit(row["vec_id"]).alias("question"), "id", "label", "score")
        out = hits if out is None else out.unionByName(hits)
    return out


_DOMAIN_PHRASES = tuple(dict.fromkeys(w for ws in [*(w for w, _ in V.DOMAINS.values()), *TAXONOMY.values(), *V.TYPE_WORDS.values(), *V.INTENT_WORDS.values()] for w in ws))


@query(f"select doc_id, list_aggregate(list_filter([{', '.join(repr(w) if chr(39) not in w else chr(39) + w.replace(chr(39), chr(39) * 2) + chr(39) for w in _DOMAIN_PHRASES)}], lambda w: contains(lower(text), w)), 'string_agg', '|') as phrases from documents")
def dictionary_phrases(spark, sf_dir):
    found = D.phrases_in(F.lower("text"), _DOMAIN_PHRASES)
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("p")).select("doc_id", F.when(F.size("p") > 0, F.array_join("p", "|")).alias("phrases"))


_MERGED = "select id % 4 as b, id, link, title, case when id % 3 = 0 then '' else content end as content, n_chars from records where link is not null and id % 2 = 1"


@query(
    RECORDS
    + f""", old as ({_OLD}), new as ({_MERGED}), folded as (select link, arg_max(title, b * 10000000000 + id) as title, arg_max(content, b * 10000000000 + id) filter (where content <> '') as content, max(n_chars) as n_chars from new group by 1)
select coalesce(o.link, n.link) as link, case when n.link is not null then n.title else o.title end as title, sha256(coalesce(n.content, o.content)) as content, greatest(o.n_chars, n.n_chars) as n_chars from old o full join folded n on o.link = n.link"""
)
def bucketed_upsert(spark, sf_dir):
    r = records(spark, sf_dir).where("link is not null")
    fields = {"title": R.OVERWRITE, "content": R.KEEP_IF_EMPTY, "n_chars": R.GREATEST}
    stored = B.Table(spark, _folder(spark), "link string, title string, content string, n_chars long", ["link"])
    bucketed = lambda df: df.withColumn(B.BUCKET, B.bucket_of(F.col("link"), 8))
    stored.append(bucketed(R.first_seen(r.where("id % 2 = 0"), "link", "id")))
    new = r.where("id % 2 = 1").withColumn("content", F.when(F.col("id") % 3 == 0, "").otherwise(F.col("content")))
    for name in (1, 3, 3, 1):  # batches that are repeated change nothing
        stored.merge(str(name), bucketed(new.where(F.col("id") % 4 == name)), lambda old, batch: bucketed(R.upsert(old.drop(B.BUCKET), batch, "link", fields, "id")))
    return stored.read().select("link", "title", F.sha2(F.col("content").cast("binary"), 256).alias("content"), "n_chars")


@query(RECORDS + "select id, link from records r where id % 2 = 1 and (link is null or not exists (select 1 from records o where o.id % 2 = 0 and o.link = r.link))")
def bucketed_new_records(spark, sf_dir):
    r, name = records(spark, sf_dir).select("id", "link"), f"links_{uuid.uuid4().hex}"
    path = _folder(spark)
    for part in (0, 2):
        B.save_links(r.where(F.col("id") % 4 == part), name, path)
    return B.not_saved(r.where("id % 2 = 1"), name)


# ---- workers as streams -------------------------------------------------------------------------


def _dealt(rows: DataFrame, by: str, parts: int) -> tuple[str, str]:
    """Rows as files in ascending order of a column, for a stream that takes some at a time; their folder and fields."""
    path = _folder(rows.sparkSession)
    rows.repartitionByRange(parts, by).sortWithinPartitions(by).write.parquet(path)
    return path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def _stream(spark, path: str, fields: str, files: int) -> DataFrame:
    return spark.readStream.schema(fields).option("maxFilesPerTrigger", files).option("latestFirst", False).parquet(path)


@query(
    """with f as (select *, (event_type = 'error')::int as bad from events), r as (select *, sum(1 - bad) over (partition by user_id order by event_id rows unbounded preceding) as ok from f),
s as (select *, cast(sum(bad) over (partition by user_id, ok order by event_id rows unbounded preceding) as integer) as streak from r)
select user_id, event_id, streak from (select *, coalesce(max((streak >= 2)::int) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as stop from s) where stop = 0"""
)
def breaker_stream(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    events.write.parquet(path := _folder(spark))
    fields, out = "user_id long, event_id long, event_type string", _folder(spark)
    stream = W.breaker_stream(_stream(spark, path, fields, 1000), "user_id", "event_id", F.col("event_type") == "error", 2)
    stream.select("user_id", "event_id", "streak").writeStream.option("checkpointLocation", P.folder(spark)).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()
    return spark.read.schema("user_id long, event_id long, streak int").parquet(out)


@query("select doc_id, sha256(text || ' ' || n_chars) as digest, 'done' as outcome from documents where n_chars >= 300 union all select doc_id, null, 'no result' from documents where not coalesce(n_chars >= 300, false)")
def polled_documents(spark, sf_dir):
    path, fields = _dealt(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), "doc_id", 6)
    target, dead, check = _folder(spark), _folder(spark), P.folder(spark)
    work = lambda batch: batch.where("n_chars >= 300").select("doc_id", F.sha2(F.concat_ws(" ", "text", "n_chars").cast("binary"), 256).alias("digest"))
    W.poll(_stream(spark, path, fields, 2), work, target, dead, "doc_id", check).awaitTermination()
    done = W.written_epochs(spark, target, "doc_id long, digest string").select("doc_id", "digest", F.lit("done").alias("outcome"))
    letters = W.written_epochs(spark, dead, "doc_id long, error string, record string")
    return done.unionByName(letters.select("doc_id", F.lit(None).cast("string").alias("digest"), F.col("error").alias("outcome")))


@query(
    f"""with f as ({_FAILURES}), c as ({_CACHE}), exact as (select f.*, (select min(copy) from c where c.k = f.k and c.url = f.url) as e from f)
select event_id, k, url, coalesce(e, (select min(copy) from c where c.k = x.k and starts_with(c.url, x.url))) as copy from exact x"""
)
def dead_letter_replay(spark, sf_dir):
    fix = lambda sql: sql.replace("varchar(9)", "string")
    failures = table(spark, sf_dir, "events").where("event_type = 'error'").selectExpr(*_items(fix(_FAILURES)[7:].split(" from ")[0]))
    cache = table(spark, sf_dir, "documents").selectExpr(*_items(fix(_CACHE)[7:].split(" from ")[0]))
    path, fields = _dealt(failures, "event_id", 4)
    W.replay(spark, path, fields, cache, "k", "url", target := _folder(spark), P.folder(spark)).awaitTermination()
    return W.written_epochs(spark, target, f"{fields}, copy long").drop(W.EPOCH)


@query(_SQL["ask_question"])
def ask_by_indexes(spark, sf_dir):
    """The question of ask_question, answered from a keyword index and a vector index."""
    asked = asked_chunks(spark, sf_dir)
    words = K.KeywordIndex(spark, _folder(spark), 8)
    words.update(asked.select("id", "number", F.col("number").alias("link"), "text"), 1)
    payload = [(f.name, f.dataType.simpleString()) for f in asked.drop("id", "embedding").schema]
    index = VI.VectorIndex(spark, _folder(spark), ", ".join(f"{n} {t}" for n, t in payload), 16)
    index.build(asked)
    plan = AS.planned(spark, "Which requirement applies to NBFC lending?")
    return AS.ask(asked, plan, first_vector(spark, sf_dir), keywords=words, vectors=index).select("rank", "id", "score")


# ---- layouts of legislation, directions and markdown ----------------------------------------------

_EDGE = "chr(10) || chr(9) || chr(13) || ' '"


def _layout(docs: DataFrame, layout: str, kind: str) -> DataFrame:
    parts = C.split_parts(docs.select("doc_id", F.expr(layout).alias("text")), kind)
    return parts.select("doc_id", "part", "title", F.sha2(F.col("content").cast("binary"), 256).alias("content"))


_RULES = "concat('Rules of ', source, '.\n', " + ", ".join(f"'Rule {i}. Matter {i} —\n', text, '\n'" for i in range(1, 5)) + ", 'Rule 5A. Last matter —\nNothing more.\n ANNEXURE ', source)"


@query(
    f"select doc_id, part, title, sha256(trim(content, {_EDGE})) as content from ("
    + " union all ".join(f"select doc_id, '{i}' as part, 'Matter {i}' as title, 'Rule {i}. Matter {i} —' || chr(10) || text as content from documents" for i in range(1, 5))
    + " union all select doc_id, '5A', 'Last matter', 'Rule 5A. Last matter —' || chr(10) || 'Nothing more.' from documents union all select doc_id, 'FORMS', 'Forms and Annexures', 'ANNEXURE ' || source from documents)"
)
def rules_parts(spark, sf_dir):
    return _layout(table(spark, sf_dir, "documents"), _RULES, "rules")


_DIRECTION = "concat(text, '\nChapter I - First matters\n', text, '\nCHAPTER II: Others\nA. First lettered part\n', lower(text), '\nB. Second lettered part\n', lower(text))"


@query(
    f"""with p as (select doc_id, trim(text, {_EDGE}) as head, 'Chapter I - First matters' || chr(10) || text as one, 'A. First lettered part' || chr(10) || lower(text) as a, 'B. Second lettered part' || chr(10) || lower(text) as b from documents),
q as (select *, trim('CHAPTER II: Others' || chr(10) || a || chr(10) || b, {_EDGE}) as two from p)
select doc_id, part, title, sha256(trim(content, {_EDGE})) as content from (select doc_id, 'PREAMBLE' as part, 'Preamble and Definitions' as title, head as content from q where length(head) > 200
union all select doc_id, 'Chapter I', 'First matters', one from q union all select doc_id, 'CHAPTER II', 'Others', two from q where length(two) <= 8000
union all select doc_id, 'CHAPTER II (A)', 'First lettered part', a from q where length(two) > 8000 union all select doc_id, 'CHAPTER II (B)', 'Second lettered part', b from q where length(two) > 8000)"""
)
def direction_parts(spark, sf_dir):
    return _layout(table(spark, sf_dir, "documents"), _DIRECTION, "direction")


_NOTE = "concat('---\nname: ', source, '\n---\n', 'Intro ', text, '\n## First \n', text, '\n##  Second\n', text)"


@query(
    f"""with p as (select doc_id, 'Intro ' || text as head, '## First ' || chr(10) || text as one, '##  Second' || chr(10) || text as two from documents), q as (select *, head || chr(10) || one || chr(10) || two as body from p)
select doc_id, part, title, sha256(content) as content from (select doc_id, '0' as part, 'Full Document' as title, body as content from q where length(body) < 2000
union all select doc_id, '0', 'Overview', trim(head, {_EDGE}) from q where length(body) >= 2000 and length(trim(head, {_EDGE})) > 50
union all select doc_id, '1', 'First', trim(one, {_EDGE}) from q where length(body) >= 2000 union all select doc_id, '2', 'Second', trim(two, {_EDGE}) from q where length(body) >= 2000)"""
)
def markdown_parts(spark, sf_dir):
    return _layout(table(spark, sf_dir, "documents"), _NOTE, "markdown")


#: A heading of each form, or none, made of the lines of all texts.
_FORMED_LINE = r"case n % 7 when 0 then '2.1.3 ' || line when 1 then '12. ' || line when 2 then 'iv. ' || line when 3 then '(7) ' || line when 4 then '  ' || upper(regexp_replace(substr(line, 1, 14), '[^a-z ]', '')) || ':  ' when 5 then 'X. ' || line else line end"


@query(
    r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as n from documents),
f as (select doc_id, n, trim(""" + _FORMED_LINE.replace("'[^a-z ]', '')", "'[^a-z ]', '', 'g')") + r""") as line from l),
h as (select doc_id, n, line, case when line = '' then 0 when regexp_matches(line, '^\d+\.\d+[\.\d]*\s+') then 1 when regexp_matches(line, '^\d+\.\s+\S') then 2 when regexp_matches(line, '(?i)^(X{0,3})(IX|IV|V?I{0,3})\.\s+') then 3
when regexp_matches(line, '^\(\d+\)\s+') then 4 when regexp_matches(line, '^[A-Z][A-Z\s]{3,}:?\s*$') then 5 else 0 end as form from f),
t as (select *, case form when 5 then regexp_extract(line, '^([A-Z][A-Z\s]{3,}):?\s*$', 1) when 4 then regexp_extract(line, '^\((\d+)\)\s+(.*)', 2) when 3 then regexp_extract(line, '(?i)^((X{0,3})(IX|IV|V?I{0,3}))\.\s+(.*)', 4) when 2 then regexp_extract(line, '^(\d+)\.\s+(\S.*)', 2) else regexp_extract(line, '^(\d+\.\d+[\.\d]*)\s+(.*)', 2) end as name,
case form when 5 then '' when 4 then regexp_extract(line, '^\((\d+)\)', 1) when 3 then regexp_extract(line, '(?i)^((X{0,3})(IX|IV|V?I{0,3}))\.', 1) when 2 then regexp_extract(line, '^(\d+)\.', 1) else regexp_extract(line, '^(\d+\.\d+[\.\d]*)', 1) end as number from h where form > 0)
select doc_id, n, case when form in (1, 4) then 2 else 1 end as level, number, case when trim(name) <> '' then trim(name) else number end as heading from t"""
)
def heading_forms(spark, sf_dir):
    formed = F.expr(rf"transform(split(text, '\n'), (line, n) -> {_FORMED_LINE})")
    made = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(formed).alias("n", "line"))
    made = made.select("doc_id", F.col("n").cast("long").alias("n"), C.heading_of(F.col("line")).alias("h"))
    return made.where("h is not null").select("doc_id", "n", "h.level", "h.number", "h.heading")


# ---- evaluation of a batch ------------------------------------------------------------------------


class Echo:
    """Stands for a model: its name and the digest of its prompt, so that an equal answer means an equal prompt."""

    def __init__(self, name: str):
        self.name = name

    def generate(self, prompt: str, temperature: float = 0.0) -> str:
        return f"{self.name} {hashlib.sha256(prompt.encode()).hexdigest()[:12]}"


class DigestJudge:
    """Stands for a judge: scores from the digest of its prompt, before they are clamped."""

    def generate(self, prompt: str, temperature: float = 0.0) -> str:
        digest = hashlib.sha256(prompt.encode()).hexdigest()
        return json.dumps({"scores": [{"criterion": c, "score": int(digest[i], 16) % 7} for i, c in enumerate(("accuracy", "depth", "nuance"))]})


def _quoted(text: str) -> str:
    """A text as SQL; its newlines are written by number."""
    return "(" + " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in text.split("\n")) + ")"


_EVALUATED = f"""with v as (select vec_id as id, label, embedding::double[] as e, case vec_id % 3 when 0 then 'rbi' when 1 then 'sebi' else 'cbic' end as source from embeddings),
q as (select id as question_id, e, 'What follows from topic ' || label || ' for number ' || id || '?' as question, case when id % 100 = 0 then null else source end as of, case when id % 4 = 0 then 'label ' || label end as truth, case when id % 150 = 0 then 'brought ' || id else '' end as custom from v where id % 50 = 0),
s as (select question_id, id, label, v.source, round(list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(v.e, v.e)), 6) as score from q, v where of is null or of = v.source),
h as (select *, row_number() over (partition by question_id order by score desc, id) as rank from (select * from s qualify row_number() over (partition by question_id order by score desc, id) <= 12) where score >= 0.35),
b as (select question_id, string_agg('[' || rank || '] Source: ' || source || ' | Circular No: C' || label || ' | Title: T' || label || ' | Relevance: ' || cast(round(cast(score as decimal(9, 6)), 2) as varchar) || chr(10) || 'text ' || id, chr(10) || chr(10) order by rank) as context,
string_agg('[Source ' || rank || '] ' || source || ' — T' || label || ' (Circular: C' || label || ', Relevance: ' || score || ')' || chr(10) || 'Content: text ' || id, chr(10) || chr(10) order by rank) as sources from h group by 1),
a as (select q.question_id, 'rag' as baseline, case when context is null then {_quoted(BE.NOTHING)} else 'rag ' || substr(sha256({_quoted(AN.system_prompt(None))} || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10) || 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || question), 1, 12) end as answer, coalesce(sources, 'No sources were retrieved.') as sources from q left join b using (question_id)
union all select question_id, n, n || ' ' || substr(sha256({_quoted(BE.UNAIDED)} || chr(10) || chr(10) || question), 1, 12), null from q, (values ('gpt'), ('gemini')) as names(n)
union all select question_id, 'custom', custom, null from q where custom <> ''),
p as (select question_id, baseline, answer, sha256('Task:' || chr(10) || case when sources is null then {_quoted(f"{AN.JUDGE} {AN.UNSOURCED}")} else {_quoted(f"{AN.JUDGE} {AN.SOURCED}")} end || chr(10) || chr(10) || 'Question:' || chr(10) || question || chr(10) || chr(10) || 'Answer:' || chr(10) || answer
|| case when truth is null then '' else chr(10) || chr(10) || 'Expected:' || chr(10) || truth end || case when sources is null then '' else chr(10) || chr(10) || 'Sources:' || chr(10) || sources end) as d from a join q using (question_id)),
scores as (select question_id, baseline, criterion, greatest(1, least(5, (instr('0123456789abcdef', substr(d, i, 1)) - 1) % 7)) as score from p, (values (1, 'accuracy'), (2, 'depth'), (3, 'nuance')) as c(i, criterion)),
m as (select question_id, baseline, cast(sum(score) as bigint) as total, round(avg(score), 2) as average from scores group by 1, 2),
r as (select question_id, baseline, answer, total, average, case when baseline <> 'rag' then round(max(case when baseline = 'rag' then average end) over (partition by question_id) - average, 2) end as advantage from p join m using (question_id, baseline))"""


def evaluated(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("source", F.expr("case vec_id % 3 when 0 then 'rbi' when 1 then 'sebi' else 'cbic' end"))
    none = F.lit(None).cast("string")
    held = e.select(F.col("vec_id").alias("id"), "source", F.expr("concat('C', label)").alias("number"), F.expr("concat('T', label)").alias("title"), none.alias("date"), none.alias("link"), F.lit("general").alias("kind"), F.lit(0).alias("chunk_index"), F.lit(1).alias("total_chunks"), F.expr("concat('text ', vec_id)").alias("text"), "embedding")
    asked = e.where("vec_id % 50 = 0").selectExpr("vec_id as question_id", "embedding", "concat('What follows from topic ', label, ' for number ', vec_id, '?') as question", "case when vec_id % 100 <> 0 then source end as source", "case when vec_id % 4 = 0 then concat('label ', label) end as truth", "case when vec_id % 150 = 0 then concat('brought ', vec_id) else '' end as custom")
    return BE.evaluate(asked, BE.retrieved(asked, held), Echo("rag"), {n: Echo(n) for n in ("gpt", "gemini")}, DigestJudge())


@query(_EVALUATED + " select question_id, baseline, answer, total, average, advantage from r")
def evaluation_answers(spark, sf_dir):
    return evaluated(spark, sf_dir)[0].drop("error")


@query(
    _EVALUATED
    + """, g as (select baseline, count(*) as questions, round(avg(average), 2) as mean, count(*) filter (where advantage > 0) as wins, count(*) filter (where advantage < 0) as losses, count(*) filter (where advantage = 0) as ties from r group by 1),
c as (select baseline, string_agg(criterion || '=' || m, ',' order by criterion) as criteria from (select baseline, criterion, round(avg(score), 2) as m from scores group by 1, 2) group by 1)
select baseline, questions, cast(0 as bigint) as failed, mean, case when baseline <> 'rag' then round((select mean from g where baseline = 'rag') - mean, 2) end as advantage,
case when baseline <> 'rag' then wins end as wins, case when baseline <> 'rag' then losses end as losses, case when baseline <> 'rag' then ties end as ties, criteria from g join c using (baseline)"""
)
def evaluation_report(spark, sf_dir):
    pairs = F.transform(F.map_entries("criteria"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))
    return evaluated(spark, sf_dir)[2].withColumn("criteria", F.array_join(pairs, ","))
