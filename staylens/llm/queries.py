"""The queries of this subpackage: each applies one operator to its whole table.

An operator keeps its own general interface; the query picks production parameters and
derives the digest columns that are compared.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.llm.chat_format import format_turns, summarize, text_part
from staylens.llm.common import table, text_or_empty
from staylens.llm.decontaminate import decontaminate
from staylens.llm.divergence import audit_sources
from staylens.llm.exact_dedup import exact_dedup, without_spaces
from staylens.llm.html_text import extract_text
from staylens.llm.line_dedup import dedup_lines
from staylens.llm.near_dedup import near_dedup
from staylens.llm.period_runs import find_runs, longest_run
from staylens.llm.phrases import drop_repeats
from staylens.llm.pieces import encode_texts
from staylens.llm import toxicity, warc
from staylens.llm.url_filter import Rule, fit, judge_urls, seed_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(body):
        QUERIES[name] = body
        if sql is not None:
            ORACLES[name] = sql
        return body

    return register


OP2_SQL = r"""
with plain as (
  select doc_id, length(coalesce(text, '')) as points,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as body from documents),
ranked as (
  select doc_id, sha256(body) as text_sha256, count(*) over (partition by body) as group_size,
    first_value(doc_id) over (partition by body order by points desc, doc_id) as keep_id from plain)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from ranked
"""


@query("op2_exact_dedup", OP2_SQL)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(without_spaces(text_or_empty("text")), 256)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", digest.alias("text_sha256"))
    return exact_dedup(docs, carry=["text_sha256"])


@query("op10_sentencepiece")
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), ids=False, digests=True)


URL_RULES = [
    Rule.parse("block", "net/"),
    Rule.parse("allow", "example.net/en/"),
    Rule.parse("block", "example.com/de/"),
    Rule.parse("allow", "org/fr/"),
]


@query("op9_url_filter")
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), fit(seed_urls(spark)), URL_RULES)


def fit_toxicity(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> toxicity.SeverityModel:
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    return toxicity.fit(docs, toxicity.grades_of(table(spark, sf_dir, "labels")))


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit_toxicity(spark, sf_dir)
    return toxicity.score_severity(table(spark, sf_dir, "documents"), model).withColumn("kept", ~F.col("toxic"))


_CONTROLS = r"\\|<\|turn\|>|<\|body\|>|<\|end\|>|<\|image\|>|<\|audio\|>|<\|document\|>|</?s>|\[/?INST\]|<</?SYS>>"
OP5_SQL = rf"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v),
sized as (
  select *, case when role = 'assistant' then text else '' end as learned,
    length('<|turn|><|body|><|end|>') + length(role) + length(text)
    + len(regexp_extract_all(role, '{_CONTROLS}')) + len(regexp_extract_all(text, '{_CONTROLS}')) as chars from turns)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  sum(length(learned))::bigint as loss_chars, sha256(string_agg(learned, '' order by turn)) as loss_sha256,
  sum(chars)::bigint as formatted_chars, 0::bigint as n_attachments, 0::bigint as attachment_tokens
from sized group by conv_id
"""


@query("op5_chat_format", OP5_SQL)
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return summarize(format_turns(turns.withColumn("parts", text_part(F.col("text")))))


def page_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as response records; their ids follow from the page ids."""
    key = F.md5(F.concat(F.lit("page "), F.col("page_id").cast("string")))
    urn = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(key, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    header = F.array(
        F.struct(F.lit("Content-Type").alias("name"), F.lit("text/html; charset=utf-8").alias("value")),
        F.struct(F.lit("Content-Length").alias("name"), F.octet_length(text_or_empty("html")).cast("string").alias("value")),
    )
    return table(spark, sf_dir, "pages").select(
        "page_id", urn.alias("record_id"), F.col("url").alias("target_uri"), F.lit("2024-01-01T00:00:00Z").alias("date"),
        F.lit(200).alias("status"), header.alias("headers"), text_or_empty("html").cast("binary").alias("payload"),
    )


@query("op6_warc")
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.serialize(warc.derive(page_responses(spark, sf_dir), carry="page_id"))
    return records.select(
        "page_id", "record_type", "record_id", "refers_to", "target_uri", "content_type", "content_length", "block_digest",
        "source_digest", F.octet_length("record").cast("long").alias("record_length"), F.sha2("record", 256).alias("record_sha256"),
    )


@query("op8_html_text")
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


OP3_SQL = r"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
sets as materialized (
  select doc_id, unnest(list_distinct(case when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end)) as s from words where len(w) > 0),
sizes as materialized (select doc_id, count(*) as n from sets group by doc_id),
links as materialized (
  select x.doc_id as a, y.doc_id as b from sets x join sets y on x.s = y.s and x.doc_id <> y.doc_id
    join sizes p on p.doc_id = x.doc_id join sizes q on q.doc_id = y.doc_id
  group by x.doc_id, y.doc_id, p.n, q.n having 100 * count(*) >= 75 * (p.n + q.n - count(*))),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
least as (select a, min(b) as b from reach group by a)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) as component_id,
  d.doc_id <= coalesce(l.b, d.doc_id) as kept
from documents d left join sizes s on s.doc_id = d.doc_id left join least l on l.a = d.doc_id
"""


@query("op3_minhash_near_dedup", OP3_SQL)
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


@query("op7_line_dedup")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "lines_removed", "first_ids", F.length("text").cast("long").alias("chars_kept"), F.sha2("text", 256).alias("text_sha256"),
    )


@query("op4_decontaminate")
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_ids", "most_matches", (~F.col("contaminated")).alias("kept"))


def plant_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of all documents, by their id, made periodic from some word on."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


@query("op13_period_runs")
def op13_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_runs(docs, prepare=plant_period, texts=False, digests=True)
    return found.withColumns(longest_run(F.col("runs"))).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"
    )


OP11_SQL = r"""
with texts as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
windows as materialized (
  select doc_id, unnest(range(1, len(w) - 18)) as spot,
    unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) as words
  from texts where len(w) >= 20),
ranked as (select doc_id, spot, row_number() over (partition by words order by doc_id, spot) as place from windows),
gone as materialized (select distinct doc_id, unnest(range(spot, spot + 20)) as spot from ranked where place > 1),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as spot from texts),
kept as (
  select doc_id, count(*) as n, string_agg(word, ' ' order by spot) as body from words anti join gone using (doc_id, spot) group by doc_id)
select t.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(body, '')) as kept_sha256
from texts t left join kept using (doc_id)
"""


@query("op11_repeated_phrases", OP11_SQL)
def op11_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents"), texts=False, digests=True)


OP12_SQL = r"""
with docs as (
  select row_number() over () as row_id, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
terms as materialized (
  select row_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
kept as materialized (select lang, term, count(*) as n from terms group by lang, term having count(distinct row_id) >= 30),
langs as (select lang, count(*) as v, sum(n) as n from kept group by lang),
places as (select distinct lang, source from docs),
counts as (select lang, source, term, count(*) as c from terms semi join kept using (lang, term) group by lang, source, term),
totals as (select lang, source, sum(c) as n from counts group by lang, source),
cells as materialized (
  select lang, source, term, coalesce(c, 0) as c,
    1 + 1000000000::hugeint * (coalesce(c, 0) + 5) // (coalesce(totals.n, 0) + 5 * langs.v) as p,
    1 + 1000000000::hugeint * (kept.n + 5) // (langs.n + 5 * langs.v) as q
  from places join kept using (lang) join langs using (lang)
    left join totals using (lang, source) left join counts using (lang, source, term)),
apart as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
  from cells a join cells b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
parts as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from places a join places b on a.lang = b.lang and a.source <> b.source
    left join apart on apart.lang = a.lang and apart.source = a.source and apart.item = b.source
  union all
  select lang, source, 'term', term, (p - q)::bigint from cells where c > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from parts)
select * from ranked where part = 'pair' or rank <= 50
"""


@query("op12_source_divergence", OP12_SQL)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))
