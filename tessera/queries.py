"""Registered queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import checks
from .functions.pystr import FLOAT_TEXT, int_size, value_kind
from .functions.shapes import shapes
from .operators.flatten import char_histogram, first_cells, first_headers, flatten, flatten_json
from .operators.profile import histogram, profile
from .plans import export, rules
from .plans.ppr import compile_rule
from .plans.scan import BASE_URL, Field, date_matches, field_matches, labels, lengths_meet, names_match, scan, scan_all, value_matches
from .rag import registry, retrieve
from .streaming.profile import drained, running_histogram

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

ORDER = {"customer": ["c_custkey"], "orders": ["o_orderkey"], "part": ["p_partkey"], "region": ["r_regionkey"], "nation": ["n_nationkey"], "supplier": ["s_suppkey"], "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], "events": ["event_id"], "documents": ["doc_id"], "labels": ["doc_id"], "pages": ["page_id"], "benchmark": ["item_id"], "conversations": ["conv_id", "turn"], "embeddings": ["vec_id"]}
COLUMNS = {
    "customer": {"c_custkey": "int", "c_name": "str", "c_nationkey": "int", "c_acctbal": "float", "c_mktsegment": "str"},
    "orders": {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "str", "o_totalprice": "float", "o_orderdate": "datetime", "o_orderpriority": "str"},
    "part": {"p_partkey": "int", "p_name": "str", "p_brand": "str", "p_type": "str", "p_size": "int", "p_retailprice": "float"},
    "region": {"r_regionkey": "int", "r_name": "str"},
    "nation": {"n_nationkey": "int", "n_name": "str", "n_regionkey": "int"},
    "supplier": {"s_suppkey": "int", "s_name": "str", "s_nationkey": "int", "s_acctbal": "float"},
    "lineitem": {"l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int", "l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_tax": "float", "l_returnflag": "str", "l_linestatus": "str", "l_shipdate": "datetime"},
    "events": {"event_id": "int", "ts": "datetime", "user_id": "int", "event_type": "str", "value": "float", "props": "str"},
    "documents": {"doc_id": "int", "text": "str", "lang": "str", "source": "str", "n_chars": "int"},
    "pages": {"page_id": "int", "url": "str", "html": "str"},
    "labels": {"doc_id": "int", "quality": "int", "toxic": "int"},
    "conversations": {"conv_id": "int", "turn": "int", "role": "str", "text": "str"},
}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Statistics

_FLOAT = FLOAT_TEXT.replace("'", "''").removeprefix("(?i)^").removesuffix("$")
KIND = f"""case when v is null then 'empty' when known <> 'str' then known when regexp_full_match(v, '[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]*') then 'empty' when regexp_full_match(v, '\\p{{Nd}}+') and v like '0%' then 'numstr' when regexp_full_match(v, '\\p{{Nd}}+') then 'int' when regexp_full_match(v, '(?i){_FLOAT}') then 'float' else 'str' end"""


def long_sql(table: str) -> str:
    """The table in long form: key, pos, v (text), known (kind by type)."""
    order = ", ".join(ORDER[table])

    def one(c: str, kind: str) -> str:
        text = f"case when extract(microsecond from {c}) % 1000000 = 0 then strftime({c}, '%Y-%m-%d %H:%M:%S') else strftime({c}, '%Y-%m-%d %H:%M:%S.%f') end" if kind == "datetime" else f"cast({c} as varchar)"
        return f"select '{c}' as key, row_number() over (order by {order}) as pos, {text} as v, '{kind}' as known from {table}"

    return " union all ".join(one(c, k) for c, k in COLUMNS[table].items())


def stats_sql(table: str) -> str:
    return f"""
with long as (select *, {KIND} as kind from ({long_sql(table)})),
cells as (select *, coalesce(v, 'None') as text, case when kind in ('int', 'float') and not isnan(cast(v as double)) then cast(v as double) end as num, known = 'str' and v <> '' as chars from (select key, pos, kind, known, v from long) where kind not in ('none')),
agg as (select key, count(*) as total, count(distinct text) as n_uniq, count(distinct kind) filter (where kind <> 'empty') as kinds, max(kind) filter (where kind <> 'empty') as only_kind, min(length(text)) as minlen, max(length(text)) as maxlen, sum(length(text)) as totallen,
  count(*) filter (where chars and regexp_matches(v, '\\p{{Nd}}')) as has_digit, count(*) filter (where chars and regexp_matches(v, '\\p{{L}}')) as has_alphas, count(*) filter (where chars and regexp_matches(v, '[^\\p{{L}}\\p{{N}}\\s]')) as has_special,
  min(num) as minval, max(num) as maxval, count(*) filter (where text in ('None', '', 'NaN', '-', 'N/A')) as n_empty from cells group by key),
words as (select key, string_agg(text, '|' order by p) as dictvalues from (select key, text, min(pos) as p from cells group by key, text) group by key)
select key, case when kinds = 1 then only_kind else 'str' end as ftype, n_uniq * 100.0::double / total <= 10 as is_dictkey, n_uniq * 100.0::double / total >= 100 as is_uniq, n_uniq, round(n_uniq * 100.0::double / total, 6) as share_uniq, minlen, maxlen, round(totallen::double / total, 6) as avglen,
  concat_ws(',', case when n_uniq = total then 'uniq' end, case when n_uniq * 100.0::double / total <= 10 then case when n_empty = total then 'empty' else 'dict' end end) as tags,
  has_digit, has_alphas, has_special, minval, maxval, has_digit > 0 as has_any_digit, has_alphas > 0 as has_any_alphas, has_special > 0 as has_any_special, case when n_uniq * 100.0::double / total <= 10 then dictvalues end as dictvalues
from agg join words using (key)"""


def plain(stats: DataFrame) -> DataFrame:
    """Lists as text, shares to six places."""
    return stats.withColumns({"tags": F.array_join("tags", ","), "dictvalues": F.array_join("dictvalues", "|"), "share_uniq": F.round("share_uniq", 6), "avglen": F.round("avglen", 6)})


for _t in ("customer", "orders", "part", "lineitem", "events", "conversations", "labels"):
    query(f"profile_{_t}", stats_sql(_t))(lambda spark, d, t=_t: plain(profile(read(spark, d, t), ORDER[t])))
for _t in ("documents", "pages"):
    query(f"profile_{_t}", stats_sql(_t))(lambda spark, d, t=_t: plain(profile(read(spark, d, t), ORDER[t])))


@query("profile_multi_table", " union all ".join(f"select '{t}' as \"table\", * from ({stats_sql(t)})" for t in ("region", "nation", "supplier")))
def _(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t in ("region", "nation", "supplier"):
        one = plain(profile(read(spark, d, t), ORDER[t])).withColumn("table", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return out


@query("value_histogram_events", f"select key as field, kind, v as value, count(*) as cnt from (select *, {KIND} as kind from ({long_sql('events')})) group by all")
def _(spark: SparkSession, d: str) -> DataFrame:
    return histogram(flatten(read(spark, d, "events"))).select("field", "kind", "value", "cnt")


@query("kind_counts", f"select key as field, {KIND} as kind, count(*) as n from (select 'props' as key, props as v, 'str' as known from events union all select 'size', cast(p_size as varchar), 'str' from part union all select 'price', cast(p_retailprice as varchar), 'str' from part union all select 'url', url, 'str' from pages union all select 'code', lpad(cast(p_size as varchar), 3, '0'), 'str' from part union all select 'blank', case when n_nationkey % 2 = 0 then ' ' else n_name end, 'str' from nation) group by all")
def _(spark: SparkSession, d: str) -> DataFrame:
    part, text = read(spark, d, "part"), T.StringType()
    rows = [
        (read(spark, d, "events"), "props", F.col("props")),
        (part, "size", F.col("p_size").cast("string")),
        (part, "price", F.col("p_retailprice").cast("string")),
        (read(spark, d, "pages"), "url", F.col("url")),
        (part, "code", F.lpad(F.col("p_size").cast("string"), 3, "0")),
        (read(spark, d, "nation"), "blank", F.when(F.col("n_nationkey") % 2 == 0, " ").otherwise(F.col("n_name"))),
    ]
    out = None
    for df, name, c in rows:
        one = df.select(F.lit(name).alias("field"), value_kind(c, text).alias("kind"))
        out = one if out is None else out.union(one)
    return out.groupBy("field", "kind").agg(F.count("*").alias("n"))


@query("int_size_buckets", "select case when l_partkey < 256 then 'uint8' when l_partkey < 65536 then 'uint16' else 'uint32' end as size, count(*) as n from lineitem group by 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy(int_size(F.col("l_partkey")).alias("size")).agg(F.count("*").alias("n"))


@query("ftype_rollup", " union all ".join(f"select '{t}' as \"table\", key, ftype from ({stats_sql(t)})" for t in ("orders", "events", "part")))
def _(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t in ("orders", "events", "part"):
        one = profile(read(spark, d, t), ORDER[t]).select(F.lit(t).alias("table"), "key", "ftype")
        out = one if out is None else out.union(one)
    return out


@query("length_stats", f"select key, minlen, maxlen, avglen from ({stats_sql('documents')}) union all select key, minlen, maxlen, avglen from ({stats_sql('customer')})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return plain(profile(read(spark, d, "documents"))).select("key", "minlen", "maxlen", "avglen").union(plain(profile(read(spark, d, "customer"))).select("key", "minlen", "maxlen", "avglen"))


@query("charclass_counts", f"select key, has_digit, has_alphas, has_special, has_any_digit, has_any_alphas, has_any_special from ({stats_sql('documents')}) union all select key, has_digit, has_alphas, has_special, has_any_digit, has_any_alphas, has_any_special from ({stats_sql('part')})")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = ["key", *[f"has_{k}" for k in ("digit", "alphas", "special")], *[f"has_any_{k}" for k in ("digit", "alphas", "special")]]
    return profile(read(spark, d, "documents")).select(c).union(profile(read(spark, d, "part")).select(c))


@query("dictionary_fields", f"select key, n_uniq, dictvalues from ({stats_sql('orders')}) where is_dictkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    return plain(profile(read(spark, d, "orders"), ORDER["orders"])).where("is_dictkey").select("key", "n_uniq", "dictvalues")


@query("uniq_and_empty_tags", "select * from (values ('c_custkey', 'uniq'), ('blank', 'dict'), ('gone', 'empty'), ('word', 'dict')) t(key, tags)")
def _(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "").otherwise("x").alias("blank"), F.when(F.col("c_custkey") % 2 == 0, "N/A").otherwise("-").alias("gone"), F.lit("same").alias("word"))
    return plain(profile(df)).select("key", "tags")


# Flattening


@query("flatten_props_json", "select 'k' as field, json_extract_string(props, '$.k') as value, count(*) as cnt from events where json_exists(props, '$.k') group by all")
def _(spark: SparkSession, d: str) -> DataFrame:
    events = read(spark, d, "events").select("event_id", F.parse_json("props").alias("v"))
    return flatten_json(events, "v", ["event_id"]).groupBy("field", "value").agg(F.count("*").alias("cnt"))


@query("header_discovery", f"select unnest(['{chr(39) + ',' + chr(39)}'])".replace("['','']", "[" + ",".join(f"'{c}'" for c in COLUMNS["lineitem"]) + "]") + " as field")
def _(spark: SparkSession, d: str) -> DataFrame:
    return first_headers(read(spark, d, "lineitem"), order_by=ORDER["lineitem"]).select("field")


@query("nested_flatten", "select 'order.id' as field, cast(o_orderkey as varchar) as value, o_orderkey as pos from orders union all select 'order.status', o_orderstatus, o_orderkey from orders union all select 'lines.flag', l_returnflag, o_orderkey from orders join lineitem on l_orderkey = o_orderkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("flag"))).alias("lines"))
    o = read(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    o = o.select(F.col("o_orderkey").alias("_id"), F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")).alias("order"), "lines", F.array("o_orderstatus").alias("dropped"))
    return flatten(o, ["_id"]).select("field", "value", F.col("pos")["_id"].alias("pos"))


@query("char_histogram", "select char, count(*) as n from (select unnest(string_split(n_name, '')) as char from nation) where char <> '' group by char")
def _(spark: SparkSession, d: str) -> DataFrame:
    return char_histogram(read(spark, d, "nation"), "n_name")


@query("sample_first_n_per_field", f"select key as field, v as value, count(*) as cnt from (select *, row_number() over (partition by key order by pos) as nth from ({long_sql('lineitem')})) where nth <= 100 group by all")
def _(spark: SparkSession, d: str) -> DataFrame:
    return first_cells(read(spark, d, "lineitem"), 100, ORDER["lineitem"]).groupBy("field", "value").agg(F.count("*").alias("cnt"))


# Rules


def _lit(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(_lit, v)) + "]::varchar[]"
    if isinstance(v, float):
        return f"{v}::double"
    return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    return "(values " + ", ".join("(" + ", ".join(map(_lit, r)) + ")" for r in rows) + f") t({names})"


def _listing() -> list[tuple]:
    """The rules as they are listed in rule_listing.csv, which was not made from the catalog; a doubled id is there twice."""
    import csv

    with (Path(__file__).parent / "rule_listing.csv").open(encoding="utf8") as f:
        return [(r["id"], r["key"], r["type"], r["match"], r["lang"], r["context"].split("."), [r["country"]] if r["country"] else [], r["imprecise"] == "1", int(r["minlen"]), int(r["maxlen"])) for r in csv.DictReader(f)]


_RULES = rules.catalog()
_LISTED = _values([(k, *r) for k, r in enumerate(_listing())], "place, id, key, type, match, lang, context, country, imprecise, minlen, maxlen")
_CATALOG = f"(select *, row_number() over (order by place) - 1 as ord from (select * from {_LISTED} qualify row_number() over (partition by id order by place) = 1))"


@query("rules_list", f"select id, key, type, match, lang, array_to_string(context, '.') as context, minlen, maxlen, imprecise from {_CATALOG}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return rules.frame(spark, _RULES).select("id", "key", "type", "match", "lang", F.array_join("context", ".").alias("context"), "minlen", "maxlen", "imprecise")


@query("rules_stats", f"select 'type' as what, type as name, count(*) as n from {_CATALOG} group by all union all select 'lang', lang, count(*) from {_CATALOG} group by all union all select 'context', c, count(*) from (select unnest(context) as c from {_CATALOG}) group by all union all select 'country', coalesce(c, 'none'), count(*) from (select unnest(case when len(country) = 0 then [null] else country end) as c from {_CATALOG}) group by all")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = rules.frame(spark, _RULES)
    parts = [("type", F.col("type")), ("lang", F.col("lang")), ("context", F.explode("context")), ("country", F.explode(F.when(F.size("country") == 0, F.array(F.lit("none"))).otherwise(F.col("country"))))]
    out = None
    for what, c in parts:
        one = r.select(F.lit(what).alias("what"), c.alias("name"))
        out = one if out is None else out.union(one)
    return out.groupBy("what", "name").agg(F.count("*").alias("n"))


@query("rule_filter_lang_context", f"select id from {_CATALOG} where type = 'field' and list_has_any(context, ['pii', 'geo']) and lang in ('common', 'ru') and not imprecise")
def _(spark: SparkSession, d: str) -> DataFrame:
    return rules.frame(spark, rules.applicable(_RULES, "field", ["pii", "geo"], ["common", "ru"])).select("id")


@query("rule_filter_country", f"select id from {_CATALOG} where list_has_any(country, ['us', 'ca'])")
def _(spark: SparkSession, d: str) -> DataFrame:
    return rules.frame(spark, rules.catalog(countries="US; ca")).select("id")


@query("country_code_norm", "select r_regionkey, list_aggregate(list_filter(list_transform(string_split(replace(upper(r_name[1:2]) || '; ' || r_name[2:3] || ', ' , ';', ','), ','), lambda x: lower(trim(x))), lambda x: x <> ''), 'string_agg', ',') as codes from region")
def _(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.upper(F.substring("r_name", 1, 2)), F.lit("; "), F.substring("r_name", 2, 2), F.lit(", "))
    rows = read(spark, d, "region").select("r_regionkey", raw.alias("raw")).collect()  # a row a region
    return spark.createDataFrame([(r.r_regionkey, ",".join(rules.country_codes(r.raw))) for r in rows], "r_regionkey int, codes string")


@query("rule_dedupe", f"select id, ord from {_CATALOG} where type = 'data'")
def _(spark: SparkSession, d: str) -> DataFrame:
    # Every rule twice: of each id the first stays, in its place.
    twice = [r for r in [*_RULES, *_RULES]]
    ord_of = {r.id: k for k, r in enumerate(rules.catalog(twice))}
    return spark.createDataFrame([(r.id, ord_of[r.id]) for r in rules.catalog(twice) if r.type == "data"], "id string, ord int")


@query("imprecise_toggle", f"select id, imprecise from {_CATALOG} where type = 'data' and lang = 'common'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return rules.frame(spark, rules.applicable(_RULES, "data", None, ["common"], ignore_imprecise=False)).select("id", "imprecise")


_NAMES = [(t, c) for t, cs in COLUMNS.items() for c in cs]
# Read off the listing by hand: "name" belongs to entitleknown, "userid" and "user_id" to usernamebyknown, "url" to websiteknown.
_NAME_HITS = "(values ('entitleknown', 'name'), ('usernamebyknown', 'user_id'), ('websiteknown', 'url')) k(ruleid, keyword)"


@query("field_rule_text", f"select \"table\", field, ruleid from {_values(_NAMES, chr(34) + 'table' + chr(34) + ', field')} join (select * from {_NAME_HITS}) on lower(field) = keyword or substr(lower(field), 3) = keyword")
def _(spark: SparkSession, d: str) -> DataFrame:
    # Names are matched whole and without the tables' one-letter prefixes.
    used = [r for r in rules.applicable(_RULES, "field") if r.match == "text"]
    hits = {(t, c, r.id) for t, c in _NAMES for name in (c, c[2:]) for r in used if name and names_match(r, Field(name, None, None, None))}
    return spark.createDataFrame(sorted(hits), "table string, field string, ruleid string")


@query("length_prefilter_pairs", f"select key as field, id as ruleid from ({stats_sql('customer').replace('key,', 'key,', 1)}) s join (select id, minlen as lo, maxlen as hi from {_CATALOG} where type = 'data' and not imprecise) r on minlen between lo and hi or lo between minlen and maxlen")
def _(spark: SparkSession, d: str) -> DataFrame:
    stats = profile(read(spark, d, "customer")).select("key", "minlen", "maxlen").collect()
    data = rules.applicable(_RULES, "data")
    pairs = [(f.key, r.id) for f in stats for r in data if lengths_meet(r, Field(f.key, "str", f.minlen, f.maxlen))]
    return spark.createDataFrame(pairs, "field string, ruleid string")


def _rule(ident: str, match: str, text: str, lo: int = 1, hi: int = 200) -> rules.Rule:
    if match == "text":
        words = text.split(",")
        return rules.Rule(ident, ident, "data", "text", keywords=frozenset(words), minlen=min(map(len, words)), maxlen=max(map(len, words)), context=("test",))
    return rules.Rule(ident, ident, "data", match, minlen=lo, maxlen=hi, regex=compile_rule(text) if match == "ppr" else None, func=text if match == "func" else None, context=("test",))


def _confidences(long: DataFrame, own: list[rules.Rule], confidence: float = 0.0, except_empty: bool = True, stop: bool = False) -> DataFrame:
    """Value rules over all values of (field, value), row by row: where most values differ, a table of the distinct ones would be held by the task that reads them."""
    h = long.select("field", "value", F.lit(1).cast("long").alias("cnt"))
    size = h.where("value is not null and value <> ''").groupBy("field").agg(F.min(F.length("value")).alias("lo"), F.max(F.length("value")).alias("hi"))
    names = [Field(r.field, "str", r.lo, r.hi) for r in size.collect()]
    numbered = [rules.Rule(**{**{k: getattr(r, k) for k in r.__dataclass_fields__}, "ord": n}) for n, r in enumerate(own)]
    return value_matches(h, names, numbered, confidence, except_empty, stop).select("field", "ruleid", F.round("confidence", 6).alias("confidence"))


_WORD_SQL = """
with vals as (select 'event_type' as field, event_type as value from events union all select 'returnflag', l_returnflag from lineitem union all select 'lang', lang from documents),
rule_words as (select * from (values ('actions', 'click'), ('actions', 'view'), ('flags', 'r'), ('flags', 'n'), ('tongues', 'en'), ('tongues', 'de')) t(ruleid, word))
select field, ruleid, round(hits * 100.0::double / total, 6) as confidence from (select v.field, w.ruleid, count(*) as hits from vals v join rule_words w on lower(value) = word group by all) join (select field, count(*) as total from vals where value <> '' group by field) using (field)"""


@query("data_text_confidence", _WORD_SQL)
def _(spark: SparkSession, d: str) -> DataFrame:
    long = read(spark, d, "events").select(F.lit("event_type").alias("field"), F.col("event_type").alias("value"))
    long = long.union(read(spark, d, "lineitem").select(F.lit("returnflag"), "l_returnflag")).union(read(spark, d, "documents").select(F.lit("lang"), "lang"))
    return _confidences(long, [_rule("actions", "text", "click,view"), _rule("flags", "text", "r,n"), _rule("tongues", "text", "en,de")])


@query("ppr_hashes", "select * from (values ('md5', 'md5hash', 100.0::double), ('sha1', 'sha1hash', 100.0::double), ('sha256', 'sha256hash', 100.0::double), ('uuid', 'uuidbyvalue', 100.0::double), ('mixed', 'md5hash', (select round(count(*) filter (where c_custkey % 3 = 0) * 100.0 / count(*), 6)::double from customer)), ('mixed', 'sha1hash', (select round(count(*) filter (where c_custkey % 3 <> 0) * 100.0 / count(*), 6)::double from customer))) t(field, ruleid, confidence)")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select("c_custkey", F.md5(F.col("c_custkey").cast("string")).alias("m"), F.sha1(F.col("c_custkey").cast("string")).alias("s"))
    part = lambda a, n: F.substring("m", a, n)
    forms = {"md5": F.col("m"), "sha1": F.col("s"), "sha256": F.sha2(F.col("c_custkey").cast("string"), 256), "uuid": F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), "mixed": F.when(F.col("c_custkey") % 3 == 0, F.col("m")).otherwise(F.col("s"))}
    long = c.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in forms.items()])).alias("x")).select("x.*")
    return _confidences(long, [r for r in _RULES if r.id in ("md5hash", "sha1hash", "sha256hash", "uuidbyvalue")])


@query("ppr_numbers", r"""
with vals as (select 'year' as field, cast(year(o_orderdate) as varchar) as value from orders union all select 'lat', printf('%.3f', o_totalprice / 5000) from orders union all select 'lon', printf('%.2f', o_totalprice / 3000) from orders union all select 'asn', 'AS' || cast(o_custkey as varchar) from orders union all select 'doi', '10.' || cast(1000 + o_custkey % 9000 as varchar) || '/x' || cast(o_orderkey as varchar) from orders),
pats as (select * from (values ('year', '\A(?:1[ \n\t\r]*[0-9]{3}|2[ \n\t\r]*[01][ \n\t\r]*[0-9]{2})\z', 4, 4), ('lat', '\A(?:[0-8][0-9]|9[0-9])\.[0-9]{1,10}\z', 4, 13), ('lon', '\A(?:1[0-8]+9|[0-9]{2})\.[0-9]{1,10}\z', 4, 13), ('asn', '\AAS[0-9]{1,5}\z', 3, 8), ('doi', '\A10\.[0-9]{4}/[!-~]+\z', 3, 100)) t(ruleid, pat, lo, hi)),
sizes as (select field, count(*) as total, min(length(value)) as mn, max(length(value)) as mx from vals group by field)
select field, ruleid, round(hits * 100.0::double / total, 6) as confidence from (select v.field, p.ruleid, count(*) as hits from vals v join pats p on length(value) between lo and hi and regexp_matches(value, pat) group by all) join sizes using (field) join pats using (ruleid) where mn between lo and hi or lo between mn and mx""")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    p = F.col("o_totalprice")
    forms = {"year": F.year("o_orderdate").cast("string"), "lat": F.round(p / 5000, 3).cast("decimal(20,3)").cast("string"), "lon": F.round(p / 3000, 2).cast("decimal(20,2)").cast("string"), "asn": F.concat(F.lit("AS"), F.col("o_custkey").cast("string")), "doi": F.concat(F.lit("10."), (1000 + F.col("o_custkey") % 9000).cast("string"), F.lit("/x"), F.col("o_orderkey").cast("string"))}
    long = o.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in forms.items()])).alias("x")).select("x.*")
    own = [
        _rule("year", "ppr", "('1' + Word(nums, exact=3)) ^ ('2' + Word('10', max=1) + Word(nums, exact=2))", 4, 4),
        _rule("lat", "ppr", "((Word('876543210', max=1) + Word(nums, exact=1)) ^ ('9' + Word(nums, exact=1))) + '.' + Word(nums, max=10)", 4, 13),
        _rule("lon", "ppr", "(('1' + Word('876543210') + Word(nums, exact=1)) ^ Word(nums, exact=2)) + '.' + Word(nums, max=10)", 4, 13),
        _rule("asn", "ppr", "Literal('AS') + Word(nums, max=5)", 3, 8),
        _rule("doi", "ppr", "Literal('10.') + Word(nums, exact=4) + '/' + Word(printables)", 3, 100),
    ]
    return _confidences(long, own)


@query("url_classify", f"select count(*) as n, count(*) filter (where regexp_matches(url, '{checks.URL}')) as urls, count(*) filter (where regexp_matches(split_part(url, '/', 3), '{checks.DOMAIN}')) as domains from pages")
def _(spark: SparkSession, d: str) -> DataFrame:
    host = F.coalesce(F.get(F.split("url", "/"), F.lit(2)), F.lit(""))
    return read(spark, d, "pages").agg(F.count("*").alias("n"), F.count_if(checks.CHECKS["url"](F.col("url"))).alias("urls"), F.count_if(checks.CHECKS["domain"](host)).alias("domains"))


_EMAIL_IN, _PHONE_IN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}"


@query("pii_in_text", f"select doc_id, len(regexp_extract_all(text, '{_EMAIL_IN}')) as emails, len(regexp_extract_all(text, '{_PHONE_IN}')) as phones from documents where regexp_matches(text, '{_EMAIL_IN}') or regexp_matches(text, '{_PHONE_IN}')")
def _(spark: SparkSession, d: str) -> DataFrame:
    # Beyond whole-value rules: the same classes within texts.
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return read(spark, d, "documents").select("doc_id", n(_EMAIL_IN).alias("emails"), n(_PHONE_IN).alias("phones")).where("emails > 0 or phones > 0")


@query("date_format_detect", "select * from (values ('iso', 'iso_date', 100.0::double), ('dots', 'dmy_dot', 100.0::double), ('slashes', 'ymd_slash', 100.0::double), ('stamp', 'iso_datetime', 100.0::double), ('half', 'iso_date', (select round(count(*) filter (where o_orderkey % 2 = 0) * 100.0 / count(*), 6)::double from orders))) t(field, format, confidence)")
def _(spark: SparkSession, d: str) -> DataFrame:
    f = lambda p: F.date_format("o_orderdate", p)
    forms = {"iso": f("yyyy-MM-dd"), "dots": f("dd.MM.yyyy"), "slashes": f("yyyy/MM/dd"), "stamp": f("yyyy-MM-dd HH:mm:ss"), "half": F.when(F.col("o_orderkey") % 2 == 0, f("yyyy-MM-dd")).otherwise("none")}
    long = read(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.explode(F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in forms.items()])).alias("x")).select("pos", "x.*")
    h = long.groupBy("field", "value").agg(F.lit(True).alias("is_str"), F.count("*").alias("cnt"), F.max("pos").alias("last_pos"))
    return date_matches(h, 5.0, True).select("field", "format", F.round("confidence", 6).alias("confidence"))


@query("fieldtype_shortcircuit", "select * from (values ('o_orderdate', '_int_fieldtype_datetime', 'datetime'), ('ts', '_int_fieldtype_datetime', 'datetime'), ('day', '_int_fieldtype_date', 'date'), ('flag', '_int_fieldtype_boolean', 'boolean')) t(field, ruleid, dataclass)")
def _(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "orders").select("o_orderdate", F.to_date("o_orderdate").alias("day"), (F.col("o_orderkey") > 5).alias("flag"), "o_totalprice")
    kinds = profile(df).select("key", "ftype").union(profile(read(spark, d, "events").select("ts")).select("key", "ftype")).collect()
    hits = field_matches([Field(r.key, r.ftype, 1, 1) for r in kinds], [], False)
    return spark.createDataFrame([(h[0], h[3], h[4]) for h in hits], "field string, ruleid string, dataclass string")


_EMPTIES = "select case when o_orderkey % 4 = 0 then '' when o_orderkey % 4 = 1 then null else o_orderstatus end as value from orders"


@query("except_empty_on_off", f"select e as except_empty, round(count(*) filter (where lower(value) in ('f', 'o')) * 100.0::double / (case when e then count(*) filter (where value <> '') else count(*) end), 6) as confidence from ({_EMPTIES}), (values (true), (false)) t(e) group by e")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    long = read(spark, d, "orders").select(F.lit("status").alias("field"), F.when(k == 0, "").when(k == 1, None).otherwise(F.col("o_orderstatus")).alias("value"))
    out = None
    for e in (True, False):
        one = _confidences(long, [_rule("status", "text", "f,o")], except_empty=e).select(F.lit(e).alias("except_empty"), "confidence")
        out = one if out is None else out.union(one)
    return out


@query("stop_on_match", "select 'lang' as field, 'some' as ruleid, round(count(*) filter (where lang in ('en', 'de')) * 100.0::double / count(*), 6) as confidence from documents where lang <> ''")
def _(spark: SparkSession, d: str) -> DataFrame:
    long = read(spark, d, "documents").select(F.lit("lang").alias("field"), F.col("lang").alias("value"))
    return _confidences(long, [_rule("none", "text", "xx,yy"), _rule("some", "text", "en,de"), _rule("all", "text", "en,de,fr,es")], stop=True)


# Reports


def _flat_report(report: DataFrame, *more: str) -> DataFrame:
    return report.select(*more, "key", "ftype", F.array_join("tags", ",").alias("tags"), "labels", F.coalesce("datatype_url", F.lit("")).alias("datatype_url"))


def _report_sql(table: str, names: str, where: str = "") -> str:
    return f"select key, ftype, tags, coalesce(l, '') as labels, case when l is null then '' else '{BASE_URL.removesuffix('{}')}' || c end as datatype_url from ({stats_sql(table)}) left join (select * from (values {names}) t(key, l, c)) using (key) {where}"


_ORDERS_LABELS = "('o_orderdate', 'datetime 100.00', 'datetime')"


@query("report_rows_full", _report_sql("orders", _ORDERS_LABELS))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _flat_report(scan(read(spark, d, "orders"), order_by=ORDER["orders"]))


@query("report_rows_short", _report_sql("orders", _ORDERS_LABELS, "where l is not null"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _flat_report(scan(read(spark, d, "orders"), order_by=ORDER["orders"]).where(F.col("labels") != ""))


@query("scan_pages", "select * from (values ('page_id', ''), ('url', 'url 100.00,url 100.00'), ('html', '')) t(key, labels)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return scan(read(spark, d, "pages"), order_by=["page_id"]).select("key", "labels")


_SCANNED = {"customer": "", "orders": _ORDERS_LABELS, "events": "('ts', 'datetime 100.00', 'datetime'), ('user_id', 'username 100.00', 'username')", "pages": "('url', 'url 100.00,url 100.00', 'url')", "nation": "", "labels": ""}


@query("end_to_end_scan", " union all ".join(f"select *, '{t}' as \"table\" from ({_report_sql(t, names or chr(40) + repr('-') + ', null, null)')})" for t, names in _SCANNED.items()))
def _(spark: SparkSession, d: str) -> DataFrame:
    tables = {t: read(spark, d, t) for t in _SCANNED}
    report = scan_all(tables, ORDER)
    return _flat_report(report, "table")


@query("shape_patterns", "select shape, count(*) as n from (select regexp_replace(regexp_replace(regexp_replace(c_name, '\\p{Nd}', '9', 'g'), '\\p{Lu}', 'A', 'g'), '\\p{Ll}', 'a', 'g') as shape from customer) group by shape")
def _(spark: SparkSession, d: str) -> DataFrame:
    return shapes(read(spark, d, "customer"), "c_name")


# Catalog payloads

# A report made of nations: a field for each region, a match for each nation, confidences in eighths.
_MATCH_SQL = "(select r_name as key, n_nationkey as ord, 'rule' || n_nationkey as ruleid, ['email', 'isbn13', 'asn', 'doi', 'datetime', 'uuid'][n_nationkey % 6 + 1] as dataclass, (15 * n_regionkey + n_nationkey % 7 * 2.125)::double as confidence from nation join region on r_regionkey = n_regionkey)"
_REPORT_SQL = f"(select key, max(confidence) as top, string_agg(dataclass || ' ' || printf('%.2f', confidence), ',' order by ord) as labels, bool_or(dataclass = 'email') as pii from {_MATCH_SQL} group by key)"


def _report(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    kinds = F.array(*map(F.lit, ("email", "isbn13", "asn", "doi", "datetime", "uuid")))
    match = F.struct(F.lit(0).alias("phase"), k.alias("ord"), F.concat(F.lit("rule"), k).alias("ruleid"), F.get(kinds, k % 6).alias("dataclass"), (15 * F.col("n_regionkey") + k % 7 * 2.125).alias("confidence"), F.lit("data").alias("ruletype"), F.lit(None).cast("string").alias("format"))
    m = n.groupBy(F.col("r_name").alias("key")).agg(F.array_sort(F.collect_list(match)).alias("matches"))
    return m.select("key", F.lit("str").alias("ftype"), F.when(F.col("key") == "ASIA", F.array(F.lit("pii"))).otherwise(F.array().cast("array<string>")).alias("tags"), "matches", labels(F.col("matches")).alias("labels"), F.concat(F.lit("u/"), F.col("matches")[0]["dataclass"]).alias("datatype_url"))


@query("best_match", f"select key, arg_max(ruleid, (confidence, -ord)) as ruleid, max(confidence) as confidence from {_MATCH_SQL} group by key")
def _(spark: SparkSession, d: str) -> DataFrame:
    best = export.best_match(F.col("matches"))
    return _report(spark, d).select("key", best["ruleid"].alias("ruleid"), best["confidence"].alias("confidence"))


@query("export_min_confidence", f"select key, count(*) as n from {_MATCH_SQL} where confidence >= 32.125 group by key")
def _(spark: SparkSession, d: str) -> DataFrame:
    return export.payload(_report(spark, d), "d", min_confidence=32.125, pii_tags=False).where("n_matches > 0").select("key", F.col("n_matches").cast("long").alias("n"))


@query("pii_tag_flags", f"select key, bool_or(dataclass in ('email', 'phone', 'ssn', 'passport', 'creditcard')) or key = 'ASIA' as pii from {_MATCH_SQL} group by key")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d).select("key", export.is_pii(F.col("tags"), F.col("matches")).alias("pii"))


@query("export_tags_terms", f"select key, string_agg(distinct upper(dataclass[1]) || dataclass[2:], ',' order by upper(dataclass[1]) || dataclass[2:]) as tags, string_agg(distinct 'urn:li:glossaryTerm:' || dataclass, ',' order by 'urn:li:glossaryTerm:' || dataclass) as terms from {_MATCH_SQL} group by key")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = export.payload(_report(spark, d), "d", pii_tags=False)
    return p.select("key", F.array_join(F.array_sort("tags"), ",").alias("tags"), F.array_join(F.array_sort("terms"), ",").alias("terms"))


@query("export_properties", f"select key, printf('%.2f', max(confidence)) as confidence, arg_max(ruleid, (confidence, -ord)) as rule_id, 'u/' || arg_min(dataclass, ord) as datatype_url from {_MATCH_SQL} group by key")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = export.payload(_report(spark, d), "d")
    return p.select("key", *[F.col("properties")[k].alias(k) for k in ("confidence", "rule_id", "datatype_url")])


@query("export_merge", f"select 'd.' || key as address, array_to_string(list_sort(list_distinct(list_concat(list(upper(dataclass[1]) || dataclass[2:]), case when key = 'EUROPE' then ['Old', 'Asn'] else [] end, case when bool_or(dataclass = 'email') or key = 'ASIA' then ['PII'] else [] end))), ',') as tags, case when key = 'EUROPE' then 'x' end as kept from {_MATCH_SQL} group by key")
def _(spark: SparkSession, d: str) -> DataFrame:
    there = spark.createDataFrame([("d.EUROPE", ["Old", "Asn"], ["t"], {"mine": "x", "rule_id": "old"})], "address string, tags array<string>, terms array<string>, properties map<string,string>")
    m = export.merged(export.payload(_report(spark, d), "d", "fqn"), there)
    return m.select("address", F.array_join(F.array_sort("tags"), ",").alias("tags"), F.col("properties")["mine"].alias("kept"))


# Retrieval and models

_PAIRS = "select a.vec_id as query_id, b.vec_id as id, b.label as label, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))) as d from embeddings a, embeddings b"


@query("knn_topk", f"select query_id, id, round(d, 4) as distance, rank from (select *, row_number() over (partition by query_id order by d, id) as rank from ({_PAIRS})) where rank <= 5")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    return retrieve.nearest(e.withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "id"), 5).withColumn("distance", F.round("distance", 4))


@query("knn_filtered_overfetch", f"select query_id, id, round(d, 4) as distance, row_number() over (partition by query_id order by d, id) as rank from (select *, row_number() over (partition by query_id order by d, id) as near from ({_PAIRS})) where near <= 15 and label < 5 qualify row_number() over (partition by query_id order by d, id) <= 5")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    return retrieve.nearest(e.withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "id"), 5, keep=F.col("label") < 5).withColumn("distance", F.round("distance", 4))


_FIRST = f"(select key, pos, v from ({long_sql('customer')}) where pos <= 100)"
_SAMPLES = f"select key as field, list(v order by pos) as samples from (select *, row_number() over (partition by key order by pos) as n from {_FIRST} where v is not null and v not in ('', 'False', '0', '0.0')) where n <= 10 group by key"


def _customer_samples(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.samples(flatten(read(spark, d, "customer").orderBy("c_custkey").limit(100), ["c_custkey"]))


@query("llm_field_samples", f"select field, array_to_string(samples, '|') as samples from ({_SAMPLES})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _customer_samples(spark, d).select("field", F.array_join("samples", "|").alias("samples"))


@query("llm_prompt_text", f"select field, 'Field: ' || field || chr(10) || 'Values: ' || array_to_string(samples[1:5], ', ') as query_text, 'Which semantic datatype does this field hold?' || chr(10) || 'Field name: ' || field || chr(10) || 'Sample values: ' || array_to_string(samples, ', ') || chr(10) || 'Candidates:' || chr(10) || '1. one' || chr(10) || '2. two' || chr(10) || 'Reply with JSON only: {{\"datatype_id\": an id of the list or null, \"confidence\": 0 to 1, \"reason\": text}}' as prompt from ({_SAMPLES})".replace("{{", "{").replace("}}", "}"))
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _customer_samples(spark, d)
    return s.select("field", retrieve.query_text(F.col("field"), F.col("samples")).alias("query_text"), retrieve.prompt(F.col("field"), F.col("samples"), F.array(F.lit("one"), F.lit("two"))).alias("prompt"))


_RESPONSES = [("a", 'Sure: {"confidence": 0.9, "datatype_id": "email", "reason": "at sign"} done'), ("b", '{"confidence": 0.2, "datatype_id": null}'), ("c", '{"datatype_id": "asn", "confidence": 7}'), ("d", "no idea"), ("e", '{"datatype_id": "x", "confidence": -1, "reason": "r"}'), ("f", None)]


@query("llm_response_parse", f"select id, json_extract_string(j, '$.datatype_id') as datatype_id, least(greatest(coalesce(try_cast(json_extract_string(j, '$.confidence') as double), 0.0), 0.0), 1.0)::double as confidence, coalesce(json_extract_string(j, '$.reason'), '') as reason from (select id, nullif(regexp_extract(r, '\\{{[\\s\\S]*\\}}'), '') as j from {_values(_RESPONSES, 'id, r')})")
def _(spark: SparkSession, d: str) -> DataFrame:
    a = spark.createDataFrame(_RESPONSES, "id string, r string").select("id", retrieve.answer(F.col("r")).alias("a"))
    return a.select("id", "a.*")


@query("hybrid_merge", f"select key, labels || case when top < 50 and r_regionkey * 0.25 >= 0.5 then ',uuid ' || printf('%.2f', r_regionkey * 25.0) else '' end as labels from {_REPORT_SQL} join region on r_name = key union all select 'blank', 'uuid 75.00' union all select 'weak', ''")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = _report(spark, d)
    none = spark.createDataFrame([("blank",), ("weak",)], "key string").select("key", F.lit("str").alias("ftype"), F.array().cast("array<string>").alias("tags"), F.array().cast(r.schema["matches"].dataType).alias("matches"), F.lit("").alias("labels"), F.lit(None).cast("string").alias("datatype_url"))
    answers = read(spark, d, "region").select(F.col("r_name").alias("key"), F.lit("uuid").alias("datatype_id"), (F.col("r_regionkey") * 0.25).alias("confidence"))
    answers = answers.union(spark.createDataFrame([("blank", "uuid", 0.75), ("weak", "uuid", 0.4)], "key string, datatype_id string, confidence double"))
    return retrieve.hybrid(r.unionByName(none), answers).select("key", "labels")


_ENTRIES = [("email", "E-mail", "An address", ["en"], ["pii", "Contact"], ["US", "ru"], ["a@b.c", "d@e.f"]), ("snils", None, "", ["ru"], ["pii"], ["RU"], []), ("asn", "AS number", "Network", ["common"], [], None, ["AS1"])]


def _registry(spark: SparkSession) -> DataFrame:
    r = spark.createDataFrame(_ENTRIES, "id string, name string, doc string, langs array<string>, categories array<string>, country array<string>, ex array<string>")
    return r.withColumn("examples", F.transform("ex", lambda x: F.struct(x.alias("value")))).withColumns({"regexp": F.lit(None).cast("string"), "classification": F.lit(None).cast("string")}).drop("ex")


@query("registry_text", "select id, concat_ws(chr(10), 'Datatype: ' || coalesce(name, id), 'Id: ' || id, 'Description: ' || nullif(doc, ''), 'Categories: ' || nullif(array_to_string(categories, ', '), ''), 'Languages: ' || nullif(array_to_string(langs, ', '), ''), 'Countries: ' || nullif(array_to_string(country, ', '), ''), 'Examples: ' || nullif(array_to_string(examples, ', '), '')) as text from " + _values(_ENTRIES, "id, name, doc, langs, categories, country, examples"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _registry(spark).select("id", registry.entry_text().alias("text"))


@query("registry_filter", "select id from " + _values(_ENTRIES, "id, name, doc, langs, categories, country, examples") + " where list_has_any(list_transform(country, lambda x: lower(x)), ['ru']) and list_has_any(list_transform(categories, lambda x: lower(x)), ['contact', 'pii'])")
def _(spark: SparkSession, d: str) -> DataFrame:
    return registry.filtered(_registry(spark), country=["RU"], categories=["contact", "PII"]).select("id")


@query("datatype_dictionary", f"select key, array_to_string(list_sort(list_distinct(flatten(list(context)))), ',') as contexts, array_to_string(list_sort(list(distinct lang)), ',') as langs, count(*) as n_rules from {_CATALOG} group by key")
def _(spark: SparkSession, d: str) -> DataFrame:
    return registry.datatype_dictionary(rules.frame(spark, _RULES)).select("key", F.array_join("contexts", ",").alias("contexts"), F.array_join("langs", ",").alias("langs"), "n_rules")


# Streams


@query("stream_histogram", "select date_trunc('hour', ts) as window_start, 'event_type' as field, event_type as value, count(*) as cnt from events group by all")
def _(spark: SparkSession, d: str) -> DataFrame:
    schema = read(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return drained(spark, running_histogram(stream, "ts")).select("window_start", "field", "value", "cnt")
