"""Queries over the supplied tables, each with the SQL that states its meaning.

The tables play the roles of a listing-review table: line items are the rated rows,
suppliers the areas, brands the property types, documents the comments. They hold no
missing values, so queries about missing values make some with ``nullif``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.functions.scalars import NUMBER
from staylens.functions.text import ENGLISH_STOP_WORDS, LETTERS, strip_non_letters
from staylens.operators import clean, distribution, evaluate, features, models, profile, stats
from staylens.operators import sentiment as mood
from staylens.operators import text as words
from staylens.operators.quantiles import quantiles
from staylens.plans import explore as explore_plan
from staylens.plans.comments import comment_report, score_comments
from staylens.runtime import use_checkpoint_dir
from staylens.sources.reviews import load_reviews, preview, save, save_bucketed

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

# A lexicon of words that do occur in the documents (their prose is invented).
POLARITIES = {
    "rewh": 0.5, "orre": -0.4, "best": 1.0, "thatin": 0.3, "ononst": -0.6, "inoran": 0.2,
    "hehely": 0.8, "orantion": -0.3, "ing": 0.1, "ment": -0.2, "eau": 0.4, "elle": 0.7,
    "eux": -0.5, "une": 0.2, "das": -0.1, "sich": 0.3, "nicht": -0.8, "mit": 0.4,
    "los": 0.2, "que": -0.1, "del": 0.6, "por": -0.7, "thble": 0.9, "thor": -0.9,
    "erre": 0.05, "eron": -0.35, "ung": 0.25, "thing": 0.15, "dans": 0.45, "sur": -0.25,
}
MULTIPLIERS = {"thth": 1.3, "tion": 1.1, "ist": 0.5, "pas": -0.5, "les": 1.5, "der": 0.8}
LEMMAS = {"thes": "the", "les": "le", "las": "la", "los": "lo", "des": "de", "erst": "er", "ments": "ment"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comments."""
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles to so many digits (adding zero turns -0.0 into 0.0)."""
    kinds = {f.name: isinstance(f.dataType, T.DoubleType) for f in df.schema.fields}
    return df.select(
        *[
            (F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if kinds[c] else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(body: Query) -> Query:
        QUERIES[name] = body
        if sql is not None:
            ORACLES[name] = sql
        return body

    return register


def r4(expression: str) -> str:
    return f"round({expression}, 4) + 0.0::double"


def _values(pairs: dict[str, object], columns: str, kind: str) -> str:
    rows = ", ".join(f"('{k}', {v!r}::{kind})" for k, v in pairs.items())
    return f"(select * from (values {rows}) as v({columns}))"


def _pairs(spark: SparkSession, pairs: dict, schema: str) -> DataFrame:
    return spark.createDataFrame(list(pairs.items()), schema)


def with_gaps(events: DataFrame) -> DataFrame:
    """Events with missing values in three columns."""
    return events.withColumns(
        {
            "event_type": F.nullif("event_type", F.lit("click")),
            "value": F.when(F.pmod("user_id", F.lit(7)) == 0, F.lit(float("nan"))).otherwise(F.col("value")),
            "user_id": F.nullif(F.col("user_id"), F.lit(8)),
        }
    )


GAPS = """(select event_id, ts, nullif(user_id, 8) as user_id, nullif(event_type, 'click') as event_type,
  case when user_id % 7 = 0 then null else value end as value, props from events)"""


# ---------------------------------------------------------------- profiling

def _describe_sql(table_name: str, cols: list[str], by: str | None) -> str:
    parts = []
    for c in cols:
        keys = f"{by}, " if by else ""
        tail = f" where {by} is not null group by {by}" if by else ""
        parts.append(
            f"select {keys}'{c}' as \"column\", count({c}) as count, {r4(f'avg({c})')} as mean, "
            f"{r4(f'stddev_samp({c})')} as std, {r4(f'min({c})')} as min, "
            f"{r4(f'quantile_cont({c}, 0.25)')} as q25, {r4(f'quantile_cont({c}, 0.5)')} as median, "
            f"{r4(f'quantile_cont({c}, 0.75)')} as q75, {r4(f'max({c})')} as max from {table_name}{tail}"
        )
    return " union all ".join(parts)


@query("describe_by_group", _describe_sql("lineitem", ["l_extendedprice"], "l_returnflag"))
def describe_by_group(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.describe_by(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice"))


@query("describe_by_area", _describe_sql("lineitem", ["l_extendedprice", "l_discount"], "l_suppkey"))
def describe_by_area(spark: SparkSession, d: str) -> DataFrame:
    return rounded(
        profile.describe_by(table(spark, d, "lineitem"), "l_suppkey", ["l_extendedprice", "l_discount"])
    )


@query("describe_numeric", _describe_sql("lineitem", MEASURES, None))
def describe_numeric(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.describe(table(spark, d, "lineitem"), MEASURES))


@query(
    "describe_categorical",
    """with c as (select o_orderpriority v, count(*) n from orders group by 1)
    select 'o_orderpriority' as "column", sum(n)::bigint as count, count(*) as "unique",
      (select v from c order by n desc, v limit 1) as top, max(n) as freq from c""",
)
def describe_categorical(spark: SparkSession, d: str) -> DataFrame:
    return profile.describe_categorical(table(spark, d, "orders"), "o_orderpriority")


@query(
    "category_counts",
    """select 'l_returnflag' as "column", l_returnflag as value, count(*) as n from lineitem group by 2
    union all select 'l_linestatus', l_linestatus, count(*) from lineitem group by 2""",
)
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.category_counts(table(spark, d, "lineitem"))


EVENT_TYPES = {
    "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint",
    "event_type": "string", "value": "double", "props": "string",
}


@query(
    "profile_info",
    " union all ".join(
        f"select '{c}' as \"column\", count({c}) as non_null, '{t}' as dtype from {GAPS}"
        for c, t in EVENT_TYPES.items()
    ),
)
def profile_info(spark: SparkSession, d: str) -> DataFrame:
    return profile.column_info(with_gaps(table(spark, d, "events")))


@query(
    "missing_summary",
    " union all ".join(
        f"select '{c}' as \"column\", count(*) - count({c}) as missing, '{t}' as dtype from {GAPS}"
        for c, t in EVENT_TYPES.items()
    ),
)
def missing_summary(spark: SparkSession, d: str) -> DataFrame:
    return profile.missing_summary(with_gaps(table(spark, d, "events")))


@query(
    "missing_percent",
    "select \"column\", round(m, 4) as missing_percent from ("
    + " union all ".join(
        f"select '{c}' as \"column\", 100.0::double * (count(*) - count({c})) / count(*) as m from {GAPS}"
        for c in EVENT_TYPES
    )
    + ") where m > 0",
)
def missing_percent(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.missing_percent(with_gaps(table(spark, d, "events"))))


@query(
    "duplicate_count",
    "select (count(*) - (select count(*) from (select distinct text, lang from documents)))::bigint "
    "as duplicates from documents",
)
def duplicate_count(spark: SparkSession, d: str) -> DataFrame:
    return profile.duplicate_count(table(spark, d, "documents"), ["text", "lang"])


@query("row_count", "select count(*) as rows from lineitem")
def row_count(spark: SparkSession, d: str) -> DataFrame:
    return profile.row_count(table(spark, d, "lineitem"))


# ------------------------------------------------------- cleaning and filters

_SUFFIX = "case p_size % 4 when 0 then '' when 1 then 'd' when 2 then ' ' else '.5' end"
_SIGN = "case p_size % 5 when 0 then '$' when 1 then '-' else '' end"
_NUMBER_SQL = NUMBER.replace("(?i:inf(inity)?)", "[iI][nN][fF]([iI][nN][iI][tT][yY])?")


@query(
    "coerce_numeric",
    f"""select p_partkey, case when regexp_matches(v, '{_NUMBER_SQL}') then try_cast(trim(v) as double) end
    as v from (select p_partkey, {_SIGN} || p_size || {_SUFFIX} as v from part)""",
)
def coerce_numeric(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", F.expr(f"concat({_SIGN}, p_size, {_SUFFIX})").alias("v"))
    return clean.coerce_numeric(part, ["v"])


_PERCENT = "case when l_linenumber = 3 then 'n/a' else concat(cast(round(l_discount * 100) as int), '%') end"


@query(
    "percent_to_ratio",
    f"""select l_orderkey, l_linenumber, case when v <> 'n/a' then cast(replace(v, '%', '') as double) / 100 end
    as v from (select l_orderkey, l_linenumber, {_PERCENT} as v from lineitem)""",
)
def percent_to_ratio(spark: SparkSession, d: str) -> DataFrame:
    rates = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_PERCENT).alias("v"))
    return clean.coerce_percent(rates, ["v"])


@query("filter_non_negative", "select * from customer where c_acctbal >= 0")
def filter_non_negative(spark: SparkSession, d: str) -> DataFrame:
    return clean.filter_min(table(spark, d, "customer"), "c_acctbal", 0)


@query("filter_equal", "select l_orderkey, l_linenumber, l_tax from lineitem where l_discount = 0")
def filter_equal(spark: SparkSession, d: str) -> DataFrame:
    free = clean.filter_equal(table(spark, d, "lineitem"), "l_discount", 0)
    return clean.select_columns(free, ["l_orderkey", "l_linenumber", "l_tax"])


@query(
    "drop_missing_subset",
    f"select event_id, event_type, user_id from {GAPS} where event_type is not null and value is not null",
)
def drop_missing_subset(spark: SparkSession, d: str) -> DataFrame:
    kept = clean.drop_missing(with_gaps(table(spark, d, "events")), ["event_type", "value"])
    return kept.select("event_id", "event_type", "user_id")


@query(
    "drop_missing_any",
    f"""select * from {GAPS} where event_id is not null and ts is not null and user_id is not null
    and event_type is not null and value is not null and props is not null""",
)
def drop_missing_any(spark: SparkSession, d: str) -> DataFrame:
    return clean.drop_missing(with_gaps(table(spark, d, "events")))


@query(
    "clean_reviews",
    """select o_orderkey as order_key, c_mktsegment as market_segment, c_acctbal as balance,
      nullif(o_orderstatus, 'P') as order_status
    from orders join customer on o_custkey = c_custkey where c_acctbal >= 0 and o_orderstatus <> 'P'""",
)
def clean_reviews(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "orders").join(
        table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    raw = joined.select(
        F.col("o_orderkey").alias("Order Key"),
        F.col("c_mktsegment").alias("Market Segment"),
        F.col("c_acctbal").cast("string").alias("Balance"),
        F.nullif("o_orderstatus", F.lit("P")).alias("Order Status"),
        F.col("c_name").alias("Customer URL"),
    )
    kept = clean.coerce_numeric(clean.drop_columns(raw, ["Customer URL"]), ["Balance"])
    kept = clean.drop_missing(clean.filter_min(kept, "Balance", 0), ["Order Status"])
    return clean.normalize_names(kept)


@query(
    "top_categories_filter",
    """select p_partkey, p_brand, p_retailprice from part where p_brand in
    (select p_brand from part group by 1 order by count(*) desc, p_brand limit 10)""",
)
def top_categories_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = stats.keep_top_categories(table(spark, d, "part"), "p_brand", 10)
    return kept.select("p_partkey", "p_brand", "p_retailprice")


@query(
    "join_with_suffix",
    """select a.s_suppkey, a.s_name, a.s_nationkey, a.s_acctbal as s_acctbal_left, b.s_acctbal as s_acctbal_right
    from supplier a left join (select s_suppkey, s_acctbal from supplier where s_acctbal >= 5000) b using (s_suppkey)""",
)
def join_with_suffix(spark: SparkSession, d: str) -> DataFrame:
    supplier = table(spark, d, "supplier")
    rich = supplier.where(F.col("s_acctbal") >= 5000).select("s_suppkey", "s_acctbal")
    return clean.join_with_suffix(supplier, rich, ["s_suppkey"], "left")


@query("preview_topn", "select * from orders order by o_orderkey limit 10")
def preview_topn(spark: SparkSession, d: str) -> DataFrame:
    return preview(table(spark, d, "orders"), 10, "o_orderkey")


@query(
    "dedupe_listings",
    """select l_suppkey, l_partkey, l_orderkey, l_linenumber from lineitem
      qualify row_number() over (partition by l_suppkey, l_partkey order by l_orderkey, l_linenumber) = 1""",
)
def dedupe_listings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")
    return profile.dedupe(rows, ["l_suppkey", "l_partkey"], ["l_orderkey", "l_linenumber"])


@query("csv_round_trip", "select c_custkey, c_name, c_nationkey::bigint as c_nationkey, c_acctbal, c_mktsegment from customer")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The customers saved as CSV in the shared checkpoint folder and loaded by column name."""
    use_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/csv-{uuid.uuid4().hex}"
    save(table(spark, d, "customer"), path, "csv")
    kinds = {"c_custkey": "long", "c_nationkey": "long", "c_acctbal": "double"}
    return load_reviews(spark, path, kinds)


@query("load_parquet", "select o_orderkey, o_totalprice, o_orderstatus from orders")
def load_parquet(spark: SparkSession, d: str) -> DataFrame:
    return load_reviews(spark, f"{d}/orders.parquet", fmt="parquet").select("o_orderkey", "o_totalprice", "o_orderstatus")


# ----------------------------------------------------------- group statistics

@query("mean_by_group", f"select l_suppkey, {r4('avg(l_extendedprice)')} as mean from lineitem group by 1")
def mean_by_group(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.mean_by(table(spark, d, "lineitem"), "l_suppkey", "l_extendedprice"))


@query("mean_by_sorted", f"select l_returnflag, {r4('avg(l_extendedprice)')} as mean from lineitem group by 1")
def mean_by_sorted(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.mean_by(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", sort="desc"))


@query(
    "mean_by_each",
    " union all ".join(
        f"select '{k}' as key, {k}::varchar as \"group\", {r4('avg(l_extendedprice)')} as mean "
        "from lineitem group by 2"
        for k in ("l_returnflag", "l_linestatus", "l_suppkey")
    ),
)
def mean_by_each(spark: SparkSession, d: str) -> DataFrame:
    keys = ["l_returnflag", "l_linestatus", "l_suppkey"]
    return rounded(stats.mean_by_each(table(spark, d, "lineitem"), keys, "l_extendedprice"))


@query(
    "top_bottom_groups",
    f"""with m as (select l_suppkey, avg(l_extendedprice) as v from lineitem group by 1)
    select l_suppkey, {r4('v')} as mean, 'top' as side from (select * from m order by v desc, l_suppkey limit 5)
    union all
    select l_suppkey, {r4('v')}, 'bottom' from (select * from m order by v, l_suppkey desc limit 5)""",
)
def top_bottom_groups(spark: SparkSession, d: str) -> DataFrame:
    means = stats.mean_by(table(spark, d, "lineitem"), "l_suppkey", "l_extendedprice")
    return rounded(stats.top_bottom(means, "l_suppkey", "mean", 5))


def _mode_sql(source: str, key: str, value: str) -> str:
    return (
        f"select {key}, {value} from (select {key}, {value}, row_number() over "
        f"(partition by {key} order by count(*) desc, {value}) as rn from {source} group by 1, 2) where rn = 1"
    )


@query("mode_by_group", f"select l_suppkey, l_quantity as mode from ({_mode_sql('lineitem', 'l_suppkey', 'l_quantity')})")
def mode_by_group(spark: SparkSession, d: str) -> DataFrame:
    return stats.mode_by(table(spark, d, "lineitem"), "l_suppkey", "l_quantity")


@query(
    "bucketed_means",
    f"""select l_suppkey, {r4('avg(l_extendedprice)')} as mean, any_value(flag) as flag
    from lineitem join (select l_suppkey, l_returnflag as flag from ({_mode_sql('lineitem', 'l_suppkey', 'l_returnflag')})) using (l_suppkey)
    group by 1""",
)
def bucketed_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean and mode per area of line items that were saved in buckets by area: no exchange."""
    use_checkpoint_dir(spark)
    name = f"line_{uuid.uuid4().hex}"
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_extendedprice", "l_returnflag")
    saved = save_bucketed(rows, name, "l_suppkey", 8, f"{spark.sparkContext.getCheckpointDir()}/{name}")
    return rounded(stats.area_profile(saved, "l_suppkey", {"mean": "l_extendedprice"}, {"flag": "l_returnflag"}, by_parts=True))


@query(
    "value_counts_topk",
    "select o_custkey, count(*) as n from orders group by 1 order by n desc, o_custkey limit 10",
)
def value_counts_topk(spark: SparkSession, d: str) -> DataFrame:
    return stats.value_counts(table(spark, d, "orders"), "o_custkey", 10)


@query("distinct_count", 'select count(distinct o_custkey) as "distinct" from orders')
def distinct_count(spark: SparkSession, d: str) -> DataFrame:
    return stats.distinct_count(table(spark, d, "orders"), "o_custkey")


@query(
    "mean_of_columns",
    " union all ".join(f"select '{c}' as \"column\", {r4(f'avg({c})')} as mean from lineitem" for c in MEASURES),
)
def mean_of_columns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.means(table(spark, d, "lineitem"), MEASURES))


_FREE = "(select * from lineitem join part on l_partkey = p_partkey where l_discount = 0)"


@query(
    "zero_price_summary",
    f"""select 'row_count' as metric, null as key, count(*)::double as value from {_FREE}
    union all select 'distinct_count', 'l_suppkey', count(distinct l_suppkey)::double from {_FREE}
    union all select 'mean', 'l_quantity', {r4('avg(l_quantity)')} from {_FREE}
    union all select 'mean', 'l_extendedprice', {r4('avg(l_extendedprice)')} from {_FREE}
    union all select 'mean', 'l_tax', {r4('avg(l_tax)')} from {_FREE}
    union all (select 'top_l_suppkey', l_suppkey::varchar, count(*)::double from {_FREE}
      group by l_suppkey order by count(*) desc, l_suppkey limit 5)
    union all (select 'top_p_brand', p_brand, count(*)::double from {_FREE}
      group by p_brand order by count(*) desc, p_brand limit 5)""",
)
def zero_price_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(
        table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")
    )
    return rounded(
        stats.subset_profile(
            rows, F.col("l_discount") == 0, "l_suppkey", ["l_suppkey", "p_brand"],
            ["l_quantity", "l_extendedprice", "l_tax"],
        )
    )


_AREA_ROWS = "(select * from lineitem join part on l_partkey = p_partkey)"
_AREA_SQL = f"""(select * from
    (select l_suppkey, {r4('avg(l_extendedprice)')} as average_rating, {r4('avg(p_retailprice)')} as average_price
      from {_AREA_ROWS} group by 1)
    full join (select l_suppkey, p_brand as common_property_type from ({_mode_sql(_AREA_ROWS, 'l_suppkey', 'p_brand')}))
      using (l_suppkey)
    full join (select l_suppkey, l_returnflag as common_room_type from ({_mode_sql(_AREA_ROWS, 'l_suppkey', 'l_returnflag')}))
      using (l_suppkey))"""


def _area_profile(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    rows = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rounded(
        stats.area_profile(
            rows,
            "l_suppkey",
            {"average_rating": "l_extendedprice", "average_price": "p_retailprice"},
            {"common_property_type": "p_brand", "common_room_type": "l_returnflag"},
        )
    )


@query("area_profile", f"select * from {_AREA_SQL}")
def area_profile(spark: SparkSession, d: str) -> DataFrame:
    return _area_profile(spark, d)


@query(
    "area_extremes",
    f"""with p as {_AREA_SQL}
    select 'top' as side, *, row_number() over (order by average_rating desc, l_suppkey)::int as rank
    from p qualify rank <= 5
    union all
    select 'bottom' as side, *, row_number() over (order by average_rating, l_suppkey desc)::int as rank
    from p qualify rank <= 5""",
)
def area_extremes(spark: SparkSession, d: str) -> DataFrame:
    return stats.area_extremes(_area_profile(spark, d), "l_suppkey", "average_rating", 5)


# ------------------------------------------------- quantiles and distributions

_PROBS = (0.05, 0.25, 0.75, 0.95)


@query(
    "quantiles",
    " union all ".join(
        f"select '{c}' as \"column\", {p}::double as p, {r4(f'quantile_cont({c}, {p})')} as quantile from lineitem"
        for c in MEASURES
        for p in _PROBS
    ),
)
def quantile_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quantiles(table(spark, d, "lineitem"), MEASURES, _PROBS))


def _band_sql(c: str) -> str:
    return (
        f"case when {c} > (select quantile_cont({c}, 0.75) from lineitem) then 'High' "
        f"when {c} < (select quantile_cont({c}, 0.25) from lineitem) then 'Low' else 'Medium' end as {c}_band"
    )


@query(
    "rating_bands",
    f"select l_orderkey, l_linenumber, l_partkey, {', '.join(_band_sql(c) for c in MEASURES)} from lineitem",
)
def rating_bands(spark: SparkSession, d: str) -> DataFrame:
    banded = stats.rating_bands(table(spark, d, "lineitem"), MEASURES)
    return banded.select("l_orderkey", "l_linenumber", "l_partkey", *[f"{c}_band" for c in MEASURES])


@query(
    "quantile_tails",
    """select o_orderkey, o_totalprice, 'high' as tail from orders
      where o_totalprice >= (select quantile_cont(o_totalprice, 0.95) from orders)
    union all select o_orderkey, o_totalprice, 'low' from orders
      where o_totalprice <= (select quantile_cont(o_totalprice, 0.05) from orders)""",
)
def quantile_tails(spark: SparkSession, d: str) -> DataFrame:
    return stats.quantile_tails(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")


@query(
    "mean_by_bin",
    f"""with e as (select min(l_discount) lo, (max(l_discount) - min(l_discount)) / 5 w from lineitem),
    b as (select l_extendedprice v, 1 + len(list_filter([1, 2, 3, 4], lambda i: l_discount > i::double * w + lo)) as bin
      from lineitem, e)
    select g.bin::int as bin, {r4('avg(v)')} as mean
    from (select unnest(range(1, 6)) as bin) g left join b on b.bin = g.bin group by 1""",
)
def mean_by_bin(spark: SparkSession, d: str) -> DataFrame:
    return rounded(distribution.mean_by_bin(table(spark, d, "lineitem"), "l_discount", "l_extendedprice", 5))


def _histogram_sql(table_name: str, c: str, bins: int) -> str:
    return (
        f"select '{c}' as \"column\", g.bin::int as bin, round(min(lo + (g.bin - 1) * w), 4) as lower, "
        f"round(min(lo + g.bin * w), 4) as upper, count(v) as n from "
        f"(select unnest(range(1, {bins + 1})) as bin, (select min({c}) from {table_name}) as lo, "
        f"(select (max({c}) - min({c})) / {bins} from {table_name}) as w) g left join "
        f"(select {c} as v, 1 + len(list_filter(range(1, {bins}), lambda i: {c} >= i::double * w + lo)) as bin "
        f"from {table_name}, (select min({c}) lo, (max({c}) - min({c})) / {bins} w from {table_name})) b "
        f"on b.bin = g.bin group by 2"
    )


@query("histogram", " union all ".join(_histogram_sql("lineitem", c, 10) for c in MEASURES))
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(distribution.histogram(table(spark, d, "lineitem"), MEASURES, 10))


@query(
    "box_stats",
    f"""with q as (select o_orderpriority k, quantile_cont(o_totalprice, 0.25) a, quantile_cont(o_totalprice, 0.5) m,
      quantile_cont(o_totalprice, 0.75) b from orders group by 1),
    j as (select *, o_totalprice between a - 1.5 * (b - a) and b + 1.5 * (b - a) as inside
      from orders join q on o_orderpriority = k)
    select k as o_orderpriority, count(*) as n, {r4('min(a)')} as q25, {r4('min(m)')} as median, {r4('min(b)')} as q75,
      {r4('least(min(case when inside then o_totalprice end), min(a))')} as whisker_low,
      {r4('greatest(max(case when inside then o_totalprice end), min(b))')} as whisker_high,
      count(case when not inside then 1 end) as outliers from j group by k""",
)
def box_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(distribution.box_stats(table(spark, d, "orders"), "o_orderpriority", "o_totalprice"))


@query(
    "box_outliers",
    """with q as (select event_type k, quantile_cont(value, 0.25) a, quantile_cont(value, 0.75) b
      from events group by 1)
    select event_id, event_type, value from events join q on event_type = k
    where value not between a - 1.5 * (b - a) and b + 1.5 * (b - a)""",
)
def box_outliers(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "event_type", "value")
    return distribution.box_outliers(events, "event_type", "value")


@query(
    "box_stats_top_categories",
    f"""with t as (select * from lineitem join part on l_partkey = p_partkey where p_brand in
      (select p_brand from lineitem join part on l_partkey = p_partkey group by 1 order by count(*) desc, p_brand limit 10)),
    q as (select p_brand k, quantile_cont(l_extendedprice, 0.25) a, quantile_cont(l_extendedprice, 0.5) m,
      quantile_cont(l_extendedprice, 0.75) b from t group by 1),
    j as (select *, l_extendedprice between a - 1.5 * (b - a) and b + 1.5 * (b - a) as inside from t join q on p_brand = k)
    select k as p_brand, count(*) as n, {r4('min(a)')} as q25, {r4('min(m)')} as median, {r4('min(b)')} as q75,
      {r4('least(min(case when inside then l_extendedprice end), min(a))')} as whisker_low,
      {r4('greatest(max(case when inside then l_extendedprice end), min(b))')} as whisker_high,
      count(case when not inside then 1 end) as outliers from j group by k""",
)
def box_stats_top_categories(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    rows = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    top = stats.keep_top_categories(rows.select("p_brand", "l_extendedprice"), "p_brand", 10)
    return rounded(distribution.box_stats(top, "p_brand", "l_extendedprice"))


_CORRELATED = MEASURES + ["l_linenumber", "l_constant"]
_CORRELATED_ROWS = "(select *, 1.0::double as l_constant from lineitem)"


def _r_sql(a: str, b: str) -> str:
    if a == b:
        return f"case when stddev_samp({a}) > 0 then 1.0::double end"
    return f"round(case when isnan(corr({a}, {b})) then null else corr({a}, {b}) end, 4) + 0.0::double"


def _correlated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").withColumn("l_constant", F.lit(1.0))


@query(
    "correlation_matrix",
    " union all ".join(
        f"select '{a}' as a, '{b}' as b, {_r_sql(a, b)} as r from {_CORRELATED_ROWS}"
        for a in _CORRELATED
        for b in _CORRELATED
    ),
)
def correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(distribution.correlation_matrix(_correlated(spark, d), _CORRELATED))


@query(
    "correlation_pair",
    "select round(corr(case when l_returnflag <> 'A' then l_quantity end, l_extendedprice), 4) as r from lineitem",
)
def correlation_pair(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn(
        "q", F.when(F.col("l_returnflag") != "A", F.col("l_quantity"))
    )
    return rounded(distribution.correlation(rows, "q", "l_extendedprice"))


_DERIVED = "(select *, l_extendedprice * (1 - l_discount) as l_revenue, l_extendedprice * l_tax as l_due from lineitem)"


@query(
    "strong_correlates",
    "select * from ("
    + " union all ".join(
        f"select '{c}' as \"column\", {_r_sql('l_extendedprice', c)} as r from {_DERIVED}"
        for c in [*MEASURES, "l_revenue", "l_due"]
    )
    + ") where r > 0.5",
)
def strong_correlates(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("l_extendedprice")
    rows = table(spark, d, "lineitem").withColumns(
        {"l_revenue": price * (1 - F.col("l_discount")), "l_due": price * F.col("l_tax")}
    )
    return rounded(distribution.strong_correlates(rows, [*MEASURES, "l_revenue", "l_due"], "l_extendedprice"))


# ---------------------------------------------------------------- whole plans

def _flat(name: str, df: DataFrame, keys: list[str], figures: list[str]) -> DataFrame:
    """(result, key, figure, value) of one result."""
    key = F.concat_ws("|", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("-")) for k in keys])
    cells = F.array(*[F.struct(F.lit(f).alias("figure"), F.col(f"`{f}`").cast("double").alias("value")) for f in figures])
    return df.select(F.lit(name).alias("result"), key.alias("key"), F.inline(cells))


def _flat_sql(name: str, sql: str, keys: list[str], figures: list[str]) -> str:
    key = " || '|' || ".join(f"coalesce({k}::varchar, '-')" for k in keys) or "''"
    return " union all ".join(
        f"select '{name}' as result, {key} as key, '{f}' as figure, {r4(f'{f}::double')} as value from ({sql})" for f in figures
    )


# Line items as reviews: quantity, tax and discount are the ratings, the first with gaps.
_EXPLORED = explore_plan.ReviewColumns(
    price="price", rating="quantity", ratings=("quantity", "l_tax", "l_discount"), numbers=("price", "l_extendedprice", "double_price"),
    host="l_partkey", neighbourhood="p_brand", area="l_suppkey", property_type="p_brand", room_type="l_returnflag",
    superhost="l_linestatus", response_time="l_linenumber", response_rate="rate", unused=("l_shipdate",), required=("l_returnflag", "l_linestatus"),
)
_FIGURES = ["count", "mean", "std", "min", "q25", "median", "q75", "max"]
_BOX = ["n", "q25", "median", "q75", "whisker_low", "whisker_high", "outliers"]


def _box_sql(source: str, k: str, v: str) -> str:
    return f"""select k, count(*) as n, min(a) as q25, min(m) as median, min(b) as q75,
      least(min(case when inside then {v} end), min(a)) as whisker_low, greatest(max(case when inside then {v} end), min(b)) as whisker_high,
      count(case when not inside then 1 end) as outliers from (
        select *, {v} between a - 1.5 * (b - a) and b + 1.5 * (b - a) as inside from {source} join (
          select {k} as k, quantile_cont({v}, 0.25) as a, quantile_cont({v}, 0.5) as m, quantile_cont({v}, 0.75) as b
          from {source} group by 1) on {k} = k) group by k"""


def _top_bottom_sql(source: str, k: str, v: str) -> str:
    means = f"(select {k} as k, avg({v}) as mean from {source} group by 1)"
    return (
        f"(select 'top' as side, * from {means} order by mean desc, k limit 5) union all "
        f"(select 'bottom' as side, * from {means} order by mean, k desc limit 5)"
    )


def _explore_sql() -> str:
    ratings = _EXPLORED.ratings
    numbers = [*ratings, *_EXPLORED.numbers]
    parts = [
        *[_flat_sql("missing", f"select '{c}' as c, count(*) - count({c}) as missing from raw", ["c"], ["missing"]) for c in ("quantity", "price", "l_tax")],
        _flat_sql("duplicates", "select count(*) - (select count(*) from (select distinct * from raw)) as duplicates from raw", [], ["duplicates"]),
        _flat_sql("price", _describe_sql("priced", ["price"], None), ['"column"'], _FIGURES),
        _flat_sql("zero_price", "select 'row_count' as metric, null as key, count(*) as value from free", ["metric", "key"], ["value"]),
        _flat_sql("zero_price", "select 'distinct_count' as metric, 'l_partkey' as key, count(distinct l_partkey) as value from free", ["metric", "key"], ["value"]),
        *[_flat_sql("zero_price", f"select 'mean' as metric, '{c}' as key, avg({c}) as value from free", ["metric", "key"], ["value"]) for c in ratings],
        _flat_sql("zero_price", "select 'top_p_brand' as metric, p_brand as key, count(*) as value from free group by 2 order by 3 desc, 2 limit 5", ["metric", "key"], ["value"]),
        _flat_sql("ratings", _describe_sql("cleaned", list(ratings), None), ['"column"'], _FIGURES),
        *[_flat_sql("rating_histograms", _histogram_sql("cleaned", c, 10), ['"column"', "bin"], ["n"]) for c in ratings],
        *[
            _flat_sql("rating_bands", f"""select '{c}' as c, case when {c} > (select quantile_cont({c}, 0.75) from cleaned) then 'High'
              when {c} < (select quantile_cont({c}, 0.25) from cleaned) then 'Low' else 'Medium' end as band, count(*) as n
              from cleaned group by 2""", ["c", "band"], ["n"])
            for c in ratings
        ],
        *[_flat_sql("correlations", f"select '{a}' as a, '{b}' as b, {_r_sql(a, b)} as r from cleaned", ["a", "b"], ["r"]) for a in numbers for b in numbers],
        *[_flat_sql("strong_correlates", f"select * from (select '{c}' as c, {_r_sql('quantity', c)} as r from cleaned) where r > 0.5", ["c"], ["r"]) for c in numbers],
        _flat_sql("room_type_boxes", _box_sql("cleaned", "l_returnflag", "quantity"), ["k"], _BOX),
        _flat_sql("by_room_type", _describe_sql("cleaned", ["quantity"], "l_returnflag"), ["l_returnflag"], _FIGURES),
        _flat_sql("property_type_boxes", f"select * from ({_box_sql('cleaned', 'p_brand', 'quantity')}) where k in (select p_brand from cleaned group by 1 order by count(*) desc, 1 limit 10)", ["k"], _BOX),
        _flat_sql("by_property_type", _describe_sql("cleaned", ["quantity"], "p_brand"), ["p_brand"], _FIGURES),
        _flat_sql("neighbourhoods", _top_bottom_sql("cleaned", "p_brand", "quantity"), ["side", "k"], ["mean"]),
        _flat_sql("postal_codes", _top_bottom_sql("cleaned", "l_suppkey", "quantity"), ["side", "k"], ["mean"]),
        _flat_sql("by_superhost", "select l_linestatus as k, avg(quantity) as mean from cleaned group by 1", ["k"], ["mean"]),
        _flat_sql("by_response_time", "select l_linenumber as k, avg(quantity) as mean from cleaned group by 1", ["k"], ["mean"]),
        _flat_sql("by_response_rate", """select g.bin, avg(v) as mean from (select unnest(range(1, 6)) as bin) g left join (
            select quantity as v, 1 + len(list_filter([1, 2, 3, 4], lambda i: p > i::double * w + lo)) as bin
            from (select quantity, l_linenumber * 10 / 100.0::double as p from cleaned),
              (select min(l_linenumber * 10 / 100.0::double) as lo, (max(l_linenumber * 10 / 100.0::double) - min(l_linenumber * 10 / 100.0::double)) / 5 as w from cleaned)
          ) b on b.bin = g.bin group by 1""", ["bin"], ["mean"]),
    ]
    return f"""with raw as materialized (select nullif(l_quantity, 7) as quantity, l_tax, l_discount, l_extendedprice, l_linenumber, l_partkey,
        l_suppkey, l_returnflag, l_linestatus, l_shipdate, p_brand, (l_linenumber * 10)::varchar || '%' as rate, 2 * l_quantity as double_price,
        case when l_linenumber = 6 then null else l_extendedprice * (l_discount - 0.01) end as price
        from lineitem join part on l_partkey = p_partkey),
      priced as materialized (select * from raw where price >= 0), free as (select * from priced where price = 0),
      cleaned as materialized (select * from priced where quantity is not null)
      """ + " union all ".join(f"select * from ({p})" for p in parts)


@query("explore_report", _explore_sql())
def explore_report(spark: SparkSession, d: str) -> DataFrame:
    """Every figure of the exploration, as (result, key, figure, value)."""
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    price = F.col("l_extendedprice") * (F.col("l_discount") - 0.01)
    rows = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.nullif(F.col("l_quantity"), F.lit(7.0)).alias("quantity"), "l_tax", "l_discount", "l_extendedprice", "l_linenumber", "l_partkey",
        "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate", "p_brand",
        F.concat((F.col("l_linenumber") * 10).cast("string"), F.lit("%")).alias("rate"), (F.col("l_quantity") * 2).alias("double_price"),
        F.when(F.col("l_linenumber") == 6, "n/a").otherwise(price.cast("string")).alias("price"),
    )
    found = explore_plan.explore(rows, _EXPLORED)
    missing = found["missing"].where(F.col("column").isin("quantity", "l_tax"))
    unpriced = clean.coerce_numeric(rows, ["price"]).select("price")
    missing = missing.select("column", "missing").unionByName(profile.missing_summary(unpriced).select("column", "missing"))
    flat = [
        _flat("missing", missing, ["column"], ["missing"]),
        _flat("duplicates", found["duplicates"], [], ["duplicates"]),
        _flat("price", found["price"], ["column"], _FIGURES),
        _flat("zero_price", found["zero_price"].distinct(), ["metric", "key"], ["value"]),
        _flat("ratings", found["ratings"], ["column"], _FIGURES),
        _flat("rating_histograms", found["rating_histograms"], ["column", "bin"], ["n"]),
        _flat("rating_bands", found["rating_bands"], ["column", "band"], ["n"]),
        _flat("correlations", found["correlations"], ["a", "b"], ["r"]),
        _flat("strong_correlates", found["strong_correlates"], ["column"], ["r"]),
        _flat("room_type_boxes", found["room_type_boxes"], ["l_returnflag"], _BOX),
        _flat("by_room_type", found["by_room_type"], ["l_returnflag"], _FIGURES),
        _flat("property_type_boxes", found["property_type_boxes"], ["p_brand"], _BOX),
        _flat("by_property_type", found["by_property_type"], ["p_brand"], _FIGURES),
        _flat("neighbourhoods", found["neighbourhoods"], ["side", "p_brand"], ["mean"]),
        _flat("postal_codes", found["postal_codes"], ["side", "l_suppkey"], ["mean"]),
        _flat("by_superhost", found["by_superhost"], ["l_linestatus"], ["mean"]),
        _flat("by_response_time", found["by_response_time"], ["l_linenumber"], ["mean"]),
        _flat("by_response_rate", found["by_response_rate"], ["bin"], ["mean"]),
    ]
    return rounded(reduce(DataFrame.unionByName, flat))


_VIF_ROWS = "(select l_quantity as x, l_extendedprice as y, l_extendedprice * l_tax as z from lineitem)"


@query(
    "vif",
    f"""with r as (select corr(x, y) as xy, corr(x, z) as xz, corr(y, z) as yz from {_VIF_ROWS}),
      d as (select *, 1 - xy * xy - xz * xz - yz * yz + 2 * xy * xz * yz as det from r)
    select 'l_quantity' as "column", {r4('(1 - yz * yz) / det')} as vif from d
    union all select 'l_extendedprice', {r4('(1 - xz * xz) / det')} from d
    union all select 'l_due', {r4('(1 - xy * xy) / det')} from d""",
)
def vif(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("l_due", F.col("l_extendedprice") * F.col("l_tax"))
    return rounded(distribution.vif(rows, ["l_quantity", "l_extendedprice", "l_due"]))


_JOINT = ["l_quantity", "l_extendedprice", "l_discount"]


def _bin_sql(c: str, bins: int = 10) -> str:
    """The bin of a value by its edges, and the lower edge of a bin."""
    step = f"((hi_{c} - lo_{c}) / {bins})"
    guess = f"least(floor(({c} - lo_{c}) / {step}), {bins - 1})"
    return (
        f"(case when {c} < {guess} * {step} + lo_{c} then {guess} "
        f"when {c} >= ({guess} + 1) * {step} + lo_{c} and {guess} < {bins - 1} then {guess} + 2 else {guess} + 1 end)::int as b_{c}, "
        f"{step} as step_{c}"
    )


@query(
    "joint_histogram",
    f"""with g as (select {', '.join(f'min({c}) as lo_{c}, max({c}) as hi_{c}' for c in _JOINT)} from lineitem),
    x as (select {', '.join(_bin_sql(c) for c in _JOINT)}, g.* from lineitem, g)
    """
    + " union all ".join(
        f"""select '{a}' as a, '{b}' as b, b_{a} as bin_a, b_{b} as bin_b, {r4(f'(b_{a} - 1) * step_{a} + lo_{a}')} as lower_a,
        {r4(f'(b_{b} - 1) * step_{b} + lo_{b}')} as lower_b, count(*) as n from x group by all"""
        for i, a in enumerate(_JOINT)
        for b in _JOINT[i + 1 :]
    ),
)
def joint_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(distribution.joint_histogram(table(spark, d, "lineitem"), _JOINT))


@query(
    "scatter_sample",
    """select o_orderkey, o_totalprice, o_custkey from orders
    order by md5(o_orderkey::varchar), o_orderkey limit 200""",
)
def scatter_sample(spark: SparkSession, d: str) -> DataFrame:
    return distribution.scatter_sample(table(spark, d, "orders"), "o_orderkey", ["o_totalprice", "o_custkey"], 200)


# ------------------------------------------------------------ text and sentiment

# The white space of the text functions, spelled out for RE2.
SPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
_STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS)
_TOKENS_SQL = (
    f"list_filter(string_split_regex(lower(regexp_replace(text, '[^{LETTERS}{SPACE}]', '', 'g')), '[{SPACE}]+'), "
    "lambda w: w <> '')"
)
_KEPT_SQL = f"list_filter({_TOKENS_SQL}, lambda w: w not in ({_STOP_SQL}))"


@query("text_normalize", f"select doc_id, array_to_string({_KEPT_SQL}, ' ') as processed_comments from documents")
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", "text")
    return words.normalize_text(docs, "text").select("doc_id", "processed_comments")


@query(
    "text_strip_limit",
    f"""select doc_id, case when head = '' then regexp_replace(text, '[^{LETTERS}{SPACE}]', '', 'g')
      else regexp_replace(head, '[^{LETTERS}{SPACE}]', '', 'g') || substr(text, length(head) + 1) end as stripped
    from (select doc_id, text, regexp_extract(text, '^(?:[{LETTERS}{SPACE}]*[^{LETTERS}{SPACE}]){{258}}') as head
      from documents)""",
)
def text_strip_limit(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", strip_non_letters("text", 258).alias("stripped"))


@query("token_counts", f"select token, count(*) as n from (select unnest({_TOKENS_SQL}) as token from documents) group by 1")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return words.token_counts(documents(spark, d), "text")


_LEMMA_SQL = _values(LEMMAS, "token, lemma", "varchar")


@query(
    "lemma_lookup",
    f"""select doc_id, array_to_string(list_transform({_KEPT_SQL}, lambda w: coalesce(
      map_extract_value(m, w), w)), ' ') as processed_comments
    from documents, (select map(list(token), list(lemma)) as m from {_LEMMA_SQL})""",
)
def lemma_lookup(spark: SparkSession, d: str) -> DataFrame:
    lemmas = _pairs(spark, LEMMAS, "token string, lemma string")
    return words.normalize_text(documents(spark, d), "text", lemmas=lemmas, key="doc_id")


def _noun_forms_sql() -> str:
    forms = ["select token, 0 as o, token as lemma from t"]
    for o, (ending, instead) in enumerate(words.NOUN_ENDINGS, start=1):
        forms.append(
            f"select token, {o}, left(token, length(token) - {len(ending)}) || '{instead}' from t "
            f"where token like '%{ending}'"
        )
    return " union all ".join(forms)


@query(
    "noun_lemmas",
    f"""with t as (select distinct unnest({_TOKENS_SQL}) as token from documents),
    best as (select token, lemma, row_number() over (partition by token order by length(lemma), o, lemma) as rn
      from ({_noun_forms_sql()}) where lemma in (select token from t))
    select token, lemma from best where rn = 1 and lemma <> token""",
)
def noun_lemmas(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = words.token_counts(documents(spark, d), "text").select("token")
    return words.noun_lemmas(vocabulary, vocabulary)


_LEXICON_SQL = _values(POLARITIES, "token, polarity", "double")
# Polarities are added as decimals on both sides: scores are equal to the last bit.
_SCORES_SQL = f"""(select d.doc_id, any_value(d.lang) as lang, any_value(d.source) as source,
    coalesce(sum(polarity::decimal(18, 9))::double / nullif(count(polarity), 0), 0.0::double) as sentiment_score
  from documents d left join (select doc_id, unnest({_KEPT_SQL}) as token from documents) w on w.doc_id = d.doc_id
  left join {_LEXICON_SQL} x on x.token = w.token group by d.doc_id)"""


def _lexicon(spark: SparkSession) -> DataFrame:
    return _pairs(spark, POLARITIES, "token string, polarity double")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return score_comments(documents(spark, d), "doc_id", "text", _lexicon(spark), ["lang", "source"])


@query("sentiment_score", f"select doc_id, sentiment_score from {_SCORES_SQL}")
def sentiment_score(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("doc_id", "sentiment_score")


_IRREGULAR = {"los": "lo", "thes": "der"}


@query(
    "noun_lemmas_irregular",
    f"""with t as (select distinct unnest({_TOKENS_SQL}) as token from documents),
    x as {_values(_IRREGULAR, "token, lemma", "varchar")},
    f as (select * from ({_noun_forms_sql()}) where o = 0 or token not in (select token from x)
      union all select token, 99, lemma from x where token in (select token from t)),
    best as (select token, lemma, row_number() over (partition by token order by length(lemma), o, lemma) as rn
      from f where lemma in (select token from t))
    select token, lemma from best where rn = 1 and lemma <> token""",
)
def noun_lemmas_irregular(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = words.token_counts(documents(spark, d), "text").select("token")
    return words.noun_lemmas(vocabulary, vocabulary, _pairs(spark, _IRREGULAR, "token string, lemma string"))


@query(
    "sentiment_score_modified",
    f"""with t as (select doc_id, {_KEPT_SQL} as w from documents),
    e as (select doc_id, unnest(w) as token, unnest(range(1, len(w) + 1)) as i from t),
    p as (select doc_id, token, lag(token) over (partition by doc_id order by i) as prior from e),
    s as (select p.doc_id, greatest(-1.0::double, least(1.0::double, polarity * coalesce(multiplier, 1.0::double)))::decimal(18, 9) as v
      from p join {_LEXICON_SQL} x on x.token = p.token
      left join {_values(MULTIPLIERS, "token, multiplier", "double")} m on m.token = p.prior)
    select d.doc_id, coalesce(sum(v)::double / nullif(count(v), 0), 0.0::double) as sentiment_score
    from documents d left join s on s.doc_id = d.doc_id group by 1""",
)
def sentiment_score_modified(spark: SparkSession, d: str) -> DataFrame:
    multipliers = _pairs(spark, MULTIPLIERS, "token string, multiplier double")
    scored = score_comments(
        documents(spark, d), "doc_id", "text", _lexicon(spark), modifiers=multipliers
    )
    return scored.select("doc_id", "sentiment_score")


_BAND_SQL = (
    "case when sentiment_score > 0.1::double then 'Positive' when sentiment_score < -0.1::double "
    "then 'Negative' else 'Neutral' end"
)


@query("sentiment_bands", f"select doc_id, {_BAND_SQL} as sentiment_category from {_SCORES_SQL}")
def sentiment_bands(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("doc_id", "sentiment_category")


@query(
    "comment_report_lemmas",
    f"""with l as {_LEMMA_SQL},
    w as (select doc_id, unnest({_KEPT_SQL}) as token from documents),
    s as materialized (select d.doc_id, any_value(d.lang) as lang, any_value(d.source) as source,
      coalesce(sum(polarity::decimal(18, 9))::double / nullif(count(polarity), 0), 0.0::double) as sentiment_score
      from documents d left join w on w.doc_id = d.doc_id left join l on l.token = w.token
      left join {_LEXICON_SQL} x on x.token = coalesce(l.lemma, w.token) group by d.doc_id)
    select 'summary' as result, '' as key, {r4('avg(sentiment_score)')} as value from s
    union all select 'median', '', {r4('median(sentiment_score)')} from s
    union all select 'by_lang', lang, {r4('avg(sentiment_score)')} from s group by 2
    union all select 'by_source', source, {r4('avg(sentiment_score)')} from s group by 2
    union all select 'bands', {_BAND_SQL}, count(*)::double from s group by 2
    union all select 'tail_high', '', count(*)::double from s where sentiment_score >= (select quantile_cont(sentiment_score, 0.95) from s)
    union all select 'tail_low', '', count(*)::double from s where sentiment_score <= (select quantile_cont(sentiment_score, 0.05) from s)""",
)
def comment_report_lemmas(spark: SparkSession, d: str) -> DataFrame:
    """The comment report with lemmas, as (result, key, value)."""
    lemmas = _pairs(spark, LEMMAS, "token string, lemma string")
    docs = documents(spark, d).withColumn("length", F.length("text"))
    found = comment_report(docs, "doc_id", "text", _lexicon(spark), ["lang", "source"], "length", lemmas=lemmas)
    pick = lambda df, name, key, value: df.select(F.lit(name).alias("result"), key.cast("string").alias("key"), value.cast("double").alias("value"))
    none = F.lit("")
    tails = found["tails"].groupBy("tail").agg(F.count(F.lit(1)).alias("n"))
    parts = [
        pick(found["summary"], "summary", none, F.col("mean")),
        pick(found["summary"], "median", none, F.col("median")),
        *[pick(found[f"by_{g}"], f"by_{g}", F.col(g), F.col("mean_sentiment")) for g in ("lang", "source")],
        pick(found["bands"], "bands", F.col("sentiment_category"), F.col("n")),
        *[pick(tails.where(F.col("tail") == t), f"tail_{t}", none, F.col("n")) for t in ("high", "low")],
    ]
    return rounded(reduce(DataFrame.unionByName, parts))


@query("sentiment_band_counts", f"select {_BAND_SQL} as sentiment_category, count(*) as n from {_SCORES_SQL} group by 1")
def sentiment_band_counts(spark: SparkSession, d: str) -> DataFrame:
    return mood.sentiment_band_counts(_scores(spark, d).drop("sentiment_category"))


@query(
    "sentiment_summary",
    f"select {r4('avg(sentiment_score)')} as mean, {r4('median(sentiment_score)')} as median from {_SCORES_SQL}",
)
def sentiment_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mood.sentiment_summary(_scores(spark, d)))


@query(
    "sentiment_by_group",
    f"""select 'lang' as key, lang as "group", {r4('avg(sentiment_score)')} as mean_sentiment from {_SCORES_SQL} group by 2
    union all select 'source', source, {r4('avg(sentiment_score)')} from {_SCORES_SQL} group by 2""",
)
def sentiment_by_group(spark: SparkSession, d: str) -> DataFrame:
    scored = _scores(spark, d)
    return rounded(stats.mean_by_each(scored, ["lang", "source"], "sentiment_score", "mean_sentiment"))


@query(
    "sentiment_tails",
    f"""with s as materialized (select * from {_SCORES_SQL})
    select doc_id, sentiment_score, 'high' as tail from s
      where sentiment_score >= (select quantile_cont(sentiment_score, 0.95) from s)
    union all select doc_id, sentiment_score, 'low' from s
      where sentiment_score <= (select quantile_cont(sentiment_score, 0.05) from s)""",
)
def sentiment_tails(spark: SparkSession, d: str) -> DataFrame:
    return mood.sentiment_tails(_scores(spark, d).select("doc_id", "sentiment_score"))


@query(
    "sentiment_histogram",
    f"with s as materialized (select * from {_SCORES_SQL}) " + _histogram_sql("s", "sentiment_score", 50),
)
def sentiment_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(distribution.histogram(_scores(spark, d), "sentiment_score", 50))


@query(
    "sentiment_rating_correlation",
    f"""select round(corr(sentiment_score, quality), 4) + 0.0::double as r
    from {_SCORES_SQL} s join labels l on l.doc_id = s.doc_id""",
)
def sentiment_rating_correlation(spark: SparkSession, d: str) -> DataFrame:
    rated = _scores(spark, d).join(table(spark, d, "labels"), "doc_id")
    return rounded(distribution.correlation(rated, "sentiment_score", "quality"))


# --------------------------------------------------------- features and evaluation

@query(
    "label_encode",
    """select o_orderkey, o_orderpriority, list_position(list_sort((select list(distinct o_orderpriority) from orders)),
      o_orderpriority)::bigint - 1 as code from orders""",
)
def label_encode(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return features.label_encode(orders, "o_orderpriority", "code", ["o_orderkey"])


@query(
    "label_encode_many",
    """select l_orderkey, l_linenumber, c_name, dense_rank() over (order by c_name) - 1 as code
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey""",
)
def label_encode_many(spark: SparkSession, d: str) -> DataFrame:
    rows = (
        table(spark, d, "lineitem")
        .join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select("l_orderkey", "l_linenumber", "c_name")
    )
    return features.label_encode(rows, "c_name", "code", ["l_orderkey", "l_linenumber"])


def _slots_sql(c: str, gap: str | None) -> str:
    value = f"nullif({c}, '{gap}')" if gap else c
    return (
        f"select '{c}' as \"column\", (row_number() over (order by v) - 1)::int as slot, v as level, n from "
        f"(select {value} as v, count(*) as n from lineitem where {value} is not null group by 1) "
        f"union all select '{c}', (count(distinct {value}))::int, null, count(*) - count({value}) from lineitem"
    )


@query("one_hot_counts", f"{_slots_sql('l_returnflag', 'R')} union all {_slots_sql('l_linestatus', None)}")
def one_hot_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("l_returnflag", F.nullif("l_returnflag", F.lit("R")))
    return features.one_hot_counts(rows, ["l_returnflag", "l_linestatus"])


@query(
    "standardize",
    "select l_orderkey, l_linenumber, l_partkey, "
    + ", ".join(
        f"{r4(f'(l.{c} - m_{c}) / s_{c}')} as {c}" for c in MEASURES
    )
    + ", 0.0::double as l_constant from lineitem l, (select "
    + ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in MEASURES)
    + " from lineitem)",
)
def standardize(spark: SparkSession, d: str) -> DataFrame:
    rows = _correlated(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", *MEASURES, "l_constant")
    return rounded(features.standardize(rows, [*MEASURES, "l_constant"]))


@query(
    "class_weights",
    f"""select o_orderstatus, count(*) as n,
      {r4('(select count(*) from orders) / ((select count(distinct o_orderstatus) from orders) * count(*))')} as weight
    from orders group by 1""",
)
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.class_weights(table(spark, d, "orders"), "o_orderstatus"))


_DRAW_SQL = "('0x' || left(md5('42' || o_orderkey::varchar), 8))::bigint"


@query(
    "hash_split",
    f"select o_orderkey, case when {_DRAW_SQL} < round(0.2 * 4294967296) then 'test' else 'train' end as split from orders",
)
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return features.hash_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "hash_split_fine",
    f"select o_orderkey, case when {_DRAW_SQL} < round(0.07 * 4294967296) then 'test' else 'train' end as split from orders",
)
def hash_split_fine(spark: SparkSession, d: str) -> DataFrame:
    return features.hash_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", test=0.07)


@query(
    "oversample",
    f"""with c as (select o_orderstatus, count(*) as n from orders group by 1),
    t as (select o_orderstatus, greatest(0.75 * (select max(n) from c) / n, 1.0)::double as times from c),
    x as (select o_orderkey, o_orderstatus, floor(times)::int
      + (case when {_DRAW_SQL} < round((times - floor(times)) * 4294967296) then 1 else 0 end) as copies
      from orders join t using (o_orderstatus))
    select o_orderkey, o_orderstatus, unnest(range(copies))::int as copy from x""",
)
def oversample(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return features.oversample(orders, "o_orderstatus", "o_orderkey", 0.75)


@query(
    "stratified_folds",
    f"""with x as (select o_orderkey, o_orderstatus, {_DRAW_SQL} as draw,
      {_DRAW_SQL} % 4096 as pile from orders)
    select o_orderkey, o_orderstatus,
      ((row_number() over (partition by o_orderstatus, pile order by draw, o_orderkey) + pile) % 5)::int as fold from x""",
)
def stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return features.stratified_folds(orders, "o_orderkey", "o_orderstatus")


_GUESS = (
    "case when o_totalprice > 300000 then 'F' when o_orderpriority = '1-URGENT' then 'O' "
    "when o_orderpriority = '5-LOW' then 'X' else 'F' end"
)


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn("guess", F.expr(_GUESS))


@query(
    "accuracy",
    f"select {r4('avg((o_orderstatus = guess)::int)')} as accuracy from (select *, {_GUESS} as guess from orders)",
)
def accuracy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.accuracy(_predicted(spark, d), "o_orderstatus", "guess"))


@query(
    "confusion_matrix",
    f"""with p as (select o_orderstatus as label, {_GUESS} as predicted from orders),
    c as (select label as v from p union select predicted from p)
    select a.v as label, b.v as predicted, (select count(*) from p where label = a.v and predicted = b.v) as n
    from c a, c b""",
)
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion_matrix(_predicted(spark, d), "o_orderstatus", "guess")


@query(
    "classification_report",
    f"""with p as (select o_orderstatus as label, {_GUESS} as predicted from orders),
    c as (select label as v from p union select predicted from p),
    s as (select v, (select count(*) from p where label = v and predicted = v) as hits,
      (select count(*) from p where label = v) as support, (select count(*) from p where predicted = v) as claims from c),
    r as (select v, hits, support, coalesce(hits / nullif(claims, 0), 0.0::double) as pr,
      coalesce(hits / nullif(support, 0), 0.0::double) as re from s),
    f as (select *, coalesce(2 * pr * re / nullif(pr + re, 0), 0.0::double) as f1 from r)
    select v as class, {r4('pr')} as precision, {r4('re')} as recall, {r4('f1')} as f1, support from f
    union all select 'accuracy', null, null, {r4('sum(hits) / sum(support)')}, sum(support)::bigint from f
    union all select 'macro avg', {r4('avg(pr)')}, {r4('avg(re)')}, {r4('avg(f1)')}, sum(support)::bigint from f
    union all select 'weighted avg', {r4('sum(pr * support) / sum(support)')}, {r4('sum(re * support) / sum(support)')},
      {r4('sum(f1 * support) / sum(support)')}, sum(support)::bigint from f""",
)
def classification_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.classification_report(_predicted(spark, d), "o_orderstatus", "guess"))


# ------------------------------------------------------------------------ models
# The class is a fixed rule of discrete columns, so a tree that is grown deep enough
# predicts the class of every row and SQL can state the figures; so does a sum of boosted trees of
# any depth, after all rounds. Depths and numbers of trees are those of the defaults.

_RULE = """case when l_quantity > 40 or (l_returnflag = 'R' and l_quantity > 25) then 'High'
  when l_linestatus = 'F' and l_linenumber <= 2 then 'Low' else 'Medium' end"""
_FITS = 4  # fits that run side by side
_CLASSES = 3  # boosted models of a fit that do, one per class


def _model_data(spark: SparkSession, d: str) -> models.ModelData:
    rows = table(spark, d, "lineitem").withColumns({
        "item": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "class": F.expr(_RULE)
    })
    return models.prepare(rows, "item", "class", ["l_quantity", "l_linenumber"], ["l_returnflag", "l_linestatus"])


_HELD_OUT = f"""(select {_RULE} as class from lineitem
  where ('0x' || left(md5('42' || concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 8))::bigint < round(0.2 * 4294967296))"""


def _sweep_sql(model: str, depths) -> str:
    return f"""select '{model}' as model, depth::int as depth, least(depth, 30)::int as fitted_depth,
      1.0::double as train_accuracy, 1.0::double as test_accuracy from (select unnest({list(depths)}) as depth)"""


def _swept(spark: SparkSession, d: str, family: models.TreeFamily, depths) -> DataFrame:
    data = _model_data(spark, d)
    try:
        return models.depth_sweep(data, family, depths, _FITS).drop("fit_seconds")
    finally:
        data.unpersist()


@query("rf_depth_sweep", _sweep_sql("random_forest", models.FOREST_SWEEP))
def rf_depth_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _swept(spark, d, models.forest(), models.FOREST_SWEEP)


@query("dt_depth_sweep", _sweep_sql("decision_tree", models.TREE_SWEEP))
def dt_depth_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _swept(spark, d, models.tree(), models.TREE_SWEEP)


@query(
    "rf_grid_search",
    f"""select 'random_forest' as model, depth::int as depth, least(depth, 30)::int as fitted_depth,
      1.0::double as mean_accuracy from (select unnest({list(models.FOREST_GRID)}) as depth)""",
)
def rf_grid_search(spark: SparkSession, d: str) -> DataFrame:
    data = _model_data(spark, d)
    scores = models.grid_search(data, models.forest(), models.FOREST_GRID, parallelism=_FITS).scores
    return scores.drop("seconds")


@query(
    "dt_grid_search",
    f"""with n as (select class, count(*) as support from {_HELD_OUT} group by class), t as (select sum(support)::bigint as support from n)
    select class, 1.0::double as "precision", 1.0::double as recall, 1.0::double as f1, support from n
    union all select 'accuracy', null, null, 1.0::double, support from t
    union all select unnest(['macro avg', 'weighted avg']), 1.0::double, 1.0::double, 1.0::double, support from t""",
)
def dt_grid_search(spark: SparkSession, d: str) -> DataFrame:
    search = models.grid_search(_model_data(spark, d), models.tree(), models.TREE_GRID, parallelism=_FITS)
    return evaluate.classification_report(search.predictions, "label", "predicted")


@query("gbt_depth_sweep")
def gbt_depth_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _swept(spark, d, models.boosted(parallelism=_CLASSES), models.BOOSTED_SWEEP)


@query(
    "gbt_cv_scores",
    f"""select 'boosted_trees' as model, depth::int as depth, depth::int as fitted_depth,
      1.0::double as mean_accuracy from (select unnest({list(models.BOOSTED_SWEEP)}) as depth)""",
)
def gbt_cv_scores(spark: SparkSession, d: str) -> DataFrame:
    family = models.boosted(parallelism=_CLASSES)
    return models.cv_scores(_model_data(spark, d), family, models.BOOSTED_SWEEP, parallelism=_FITS).drop("seconds")


@query(
    "gbt_final",
    f"""with n as (select class, count(*) as n from {_HELD_OUT} group by class)
    select x.class as label, y.class as predicted, case when x.class = y.class then x.n else 0 end as n from n x, n y""",
)
def gbt_final(spark: SparkSession, d: str) -> DataFrame:
    data = _model_data(spark, d)
    model = models.fit_depth(data, models.boosted(parallelism=_CLASSES), models.BOOSTED_FINAL)
    return evaluate.confusion_matrix(models.predict(data, model), "label", "predicted")
