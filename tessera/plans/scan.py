"""Classification of every field, and the report.

Names and per-field statistics, a row a field, come to the driver, which plans
with them as an optimiser would: it settles the name rules, drops fields whose
type says all, and prunes value rules by length and gate. The value rules that
are left for some field become conditional counts of a single aggregate over
the histogram of the first `limit` values; no rule is joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.pystr import confidence_text
from ..operators.flatten import HIDDEN, first_cells, flatten, headers, is_flat
from ..operators.profile import DICT_SHARE, EMPTY_VALUES, parts
from .rules import Rule, applicable, catalog

if TYPE_CHECKING:
    from ..rag.classifier import Classifier

BASE_URL = "https://registry.example.org/datatype/{}"
CONFIDENCE = 5.0
LIMIT = 1000
TYPED = {"bool": ("_int_fieldtype_boolean", "boolean"), "datetime": ("_int_fieldtype_datetime", "datetime"), "date": ("_int_fieldtype_date", "date")}
LLM_LEAST = 50.0
MODES = ("rules", "llm", "hybrid")
FOUND = "field string, phase int, ord int, ruleid string, dataclass string, confidence double, ruletype string, format string"
MATCH = "array<struct<phase:int,ord:int,ruleid:string,dataclass:string,confidence:double,ruletype:string,format:string>>"


@dataclass(frozen=True)
class Field:
    name: str
    ftype: str | None
    minlen: int | None
    maxlen: int | None

    @property
    def short(self) -> str:
        return self.name.rpartition(".")[2].strip()


def java(pattern: str) -> re.Pattern:
    """The same pattern for Python's engine."""
    pattern = re.sub(r"\\Q(.*?)\\E", lambda m: re.escape(m[1]), pattern, flags=re.S).replace(r"\z", r"\Z")
    return re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern))


def names_match(r: Rule, f: Field) -> bool:
    """Whether a name rule matches the field's short name or its whole path."""
    if r.match == "text":
        return bool({f.short.lower(), f.name.lower()} & r.keywords)
    if r.match == "func":
        return any(checks.holds(r.func, n) for n in (f.short, f.name))
    return any(java(r.regex).search(n) for n in (f.short, f.name)) if r.regex else False


def gate_open(r: Rule, f: Field) -> bool:
    if r.gate is not None:
        return java(r.gate).search(f.short) is not None
    return not r.gate_keywords or f.short.lower() in r.gate_keywords


def lengths_meet(r: Rule, f: Field) -> bool:
    if f.minlen is None:
        low, high = 4, 4
    else:
        low, high = f.minlen, f.maxlen
    return r.minlen <= low <= r.maxlen or low <= r.minlen <= high


def value_condition(r: Rule, v: Column) -> Column:
    if r.match == "text":
        return F.lower(v).isin(*sorted(r.keywords))
    ok = checks.CHECKS[r.func](v) if r.match == "func" else v.rlike(r.regex)
    if r.match == "ppr" and r.validator:
        ok = ok & checks.CHECKS[r.validator](v)
    return ok


def field_matches(fields: Iterable[Field], rules: Iterable[Rule], stop_on_match: bool) -> list[tuple]:
    out = []
    for f in fields:
        hits = [(f.name, 0, r.ord, r.id, r.key, 100.0, "field", None) for r in rules if names_match(r, f)]
        out += hits[:1] if stop_on_match else hits
        if f.ftype in TYPED:
            out.append((f.name, 1, 0, *TYPED[f.ftype], 100.0, "fieldtype", None))
    return out


def value_matches(h: DataFrame, fields: list[Field], rules: list[Rule], confidence: float, except_empty: bool, stop_on_match: bool) -> DataFrame:
    """(field, phase, ord, ruleid, dataclass, confidence, ruletype, format). h: (field, value, cnt) of the first values."""
    spark = h.sparkSession
    open_fields = [f for f in fields if f.ftype not in TYPED and f.ftype != "float"]
    pairs = [(r, [f.name for f in open_fields if lengths_meet(r, f) and gate_open(r, f)]) for r in rules]
    pairs = [(r, names) for r, names in pairs if names]
    if not pairs:
        return spark.createDataFrame([], FOUND)
    v, n = F.col("value"), F.col("cnt")
    full = v.isNotNull() & (v != "")
    h = h.where(F.col("field").isin(*{x for _, names in pairs for x in names}))
    counts = [F.sum(F.when(F.col("field").isin(*names) & full & F.length(v).between(r.minlen, r.maxlen) & value_condition(r, v), n)).alias(f"r{k}") for k, (r, names) in enumerate(pairs)]
    per = h.groupBy("field").agg(F.sum(F.when(full, n) if except_empty else n).alias("total"), *counts)
    rows = F.array(*[F.struct(F.lit(2).alias("phase"), F.lit(r.ord).alias("ord"), F.lit(r.id).alias("ruleid"), F.lit(r.key).alias("dataclass"), F.coalesce(F.try_divide(F.col(f"r{k}") * 100.0, "total"), F.lit(0.0)).alias("confidence")) for k, (r, _) in enumerate(pairs)])
    hits = per.select("field", F.explode(rows).alias("m")).select("field", "m.*").where(F.col("confidence") > confidence)
    if stop_on_match:
        hits = hits.selectExpr("*", "row_number() over (partition by field order by ord) as nth").where("nth = 1").drop("nth")
    return hits.withColumns({"ruletype": F.lit("data"), "format": F.lit(None).cast("string")})


def date_matches(h: DataFrame, confidence: float, except_empty: bool) -> DataFrame:
    """Fields whose texts have a date layout; format is that of the last one. h: (field, value, is_str, cnt, last_pos)."""
    full = F.col("value").isNotNull() & (F.col("value") != "")
    key = F.when(full & F.col("is_str"), checks.date_pattern(F.col("value")))
    per = h.withColumn("pattern", key).groupBy("field").agg(F.sum(F.when(full, F.col("cnt")) if except_empty else F.col("cnt")).alias("total"), F.sum(F.when(F.col("pattern").isNotNull(), F.col("cnt"))).alias("hit"), F.max_by("pattern", F.when(F.col("pattern").isNotNull(), F.col("last_pos"))).alias("format"))
    per = per.withColumn("confidence", F.coalesce(F.try_divide(F.col("hit") * 100.0, "total"), F.lit(0.0))).where(F.col("confidence") > confidence)
    return per.select("field", F.lit(3).alias("phase"), F.lit(0).alias("ord"), F.lit("qddate").alias("ruleid"), F.lit("datetime").alias("dataclass"), "confidence", F.lit("data").alias("ruletype"), "format")


def scan(
    df: DataFrame,
    rules: Iterable[Rule] | None = None,
    limit: int = LIMIT,
    contexts: Iterable[str] | None = None,
    langs: Iterable[str] | None = None,
    confidence: float = CONFIDENCE,
    except_empty: bool = True,
    parse_dates: bool = True,
    stop_on_match: bool = False,
    ignore_imprecise: bool = True,
    fields: list[str] | None = None,
    stats_only: bool = False,
    dict_share: float = DICT_SHARE,
    empty_values: tuple[str, ...] = EMPTY_VALUES,
    order_by: list[str] | None = None,
    strict: bool = True,
    base_url: str = BASE_URL,
    mode: str = "rules",
    classifier: Classifier | None = None,
    llm_least: float = LLM_LEAST,
) -> DataFrame:
    """One row a field: its statistics and, unless stats_only, matches (a list), labels (their text) and datatype_url (of the first).

    mode: rules; llm, all fields by the classifier alone, fields left aside (without a classifier the rules are used); hybrid, the
    classifier for fields whose best match is under llm_least.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}, not {mode!r}")
    own, words = parts(df, order_by, None, dict_share, empty_values)
    if stats_only:
        return own.join(words, "key", "left")
    spark = df.sparkSession
    used = catalog(rules, strict=strict)
    head = df.orderBy(*order_by).limit(1000) if order_by else df.limit(1000)
    if is_flat(df.schema):
        names = [f.name for f in df.schema if f.name != HIDDEN] if not head.isEmpty() else []  # a flat table has all fields in its first record
        seen = [(n, k) for k, n in enumerate(sorted(names), 1)]
    else:
        seen = [(r.field, r.ord) for r in headers(flatten(head, order_by), None).collect()]
    if mode == "llm" and classifier is not None:
        none = spark.createDataFrame([], FOUND)
        order = spark.createDataFrame(seen, "key string, ord int")
        out = report(own.join(words, "key", "left"), none, base_url).join(order, "key").orderBy("ord").drop("ord")
        return by_model(out, head, order_by, classifier, langs, contexts, -1.0, base_url)
    if fields:
        missing = set(fields) - {n for n, _ in seen}
        if missing:
            raise KeyError(f"no such fields: {sorted(missing)}")
        seen = [(n, k) for k, n in enumerate(fields)]
    known = {r.key: r for r in own.select("key", "ftype", "minlen", "maxlen").collect()}
    # Where an empty text stands beside a missing value, lengths can't be told and count as 4.
    blank = [n for n, _ in seen if n in known and known[n].minlen == 0]
    unknown = {r.field for r in flatten(df, None, blank).where("value is null").select("field").distinct().collect()} if blank else set()
    size = lambda n: (None, None) if n in unknown else (known[n].minlen, known[n].maxlen)
    targets = [Field(n, known[n].ftype, *size(n)) if n in known else Field(n, None, None, None) for n, _ in seen]
    first = first_cells(df, limit, order_by)
    h = first.groupBy("field", "value", "is_str").agg(F.count("*").alias("cnt"), F.max("pos").alias("last_pos"))
    named = spark.createDataFrame(field_matches(targets, applicable(used, "field", contexts, langs, ignore_imprecise), stop_on_match), FOUND)
    found = named.unionByName(value_matches(h, targets, applicable(used, "data", contexts, langs, ignore_imprecise), confidence, except_empty, stop_on_match))
    if parse_dates:
        texts = [f.name for f in targets if f.ftype in ("str", None)]
        open_ = h.where(F.col("field").isin(*texts)) if texts else h.limit(0)
        found = found.unionByName(date_matches(open_.join(found.select("field").distinct(), "field", "left_anti"), confidence, except_empty))
    order = spark.createDataFrame([(n, k) for k, (n, _) in enumerate(seen)], "key string, ord int")
    out = report(own.join(words, "key", "left"), found, base_url).join(order, "key").orderBy("ord").drop("ord")
    return by_model(out, head, order_by, classifier, langs, contexts, llm_least, base_url) if mode == "hybrid" and classifier is not None else out


def by_model(out: DataFrame, head: DataFrame, order_by: list[str] | None, classifier: Classifier, langs: Iterable[str] | None, contexts: Iterable[str] | None, least: float, base_url: str) -> DataFrame:
    """A report with the classifier's answers for the fields whose best match is under least (all for a negative one). Samples are the first ten values with anything in them of the first 100 records, of top-level fields."""
    from ..rag import retrieve

    first = head.orderBy(*order_by).limit(100) if order_by else head.limit(100)
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["confidence"])), F.lit(-1.0))
    open_ = out.where(best < least) if least >= 0 else out
    asks = open_.select(F.col("key").alias("field")).join(retrieve.samples(flatten(first, order_by)), "field", "left")
    answers = classifier.classify(asks, langs=langs, categories=contexts)
    if least < 0:
        answers = answers.where("datatype_id is not null and confidence > 0")
    return retrieve.hybrid(out, answers, least, base_url)


def report(stats: DataFrame, found: DataFrame, base_url: str = BASE_URL) -> DataFrame:
    """Statistics with the matches of each field in order, their text and the first one's address."""
    rows = found.groupBy(F.col("field").alias("key")).agg(F.array_sort(F.collect_list(F.struct("phase", "ord", "ruleid", "dataclass", "confidence", "ruletype", "format"))).alias("matches"))
    out = stats.join(rows, "key", "left").withColumn("matches", F.coalesce("matches", F.array().cast(MATCH)))
    return out.withColumn("labels", labels(F.col("matches"))).withColumn("datatype_url", F.when(F.size("matches") > 0, F.replace(F.lit(base_url), F.lit("{}"), F.col("matches")[0]["dataclass"])))


def labels(matches: Column) -> Column:
    """dataclass, confidence to two decimals and the format of every match, joined by commas."""
    one = lambda m: F.concat(m["dataclass"], F.lit(" "), confidence_text(m["confidence"]), F.coalesce(F.concat(F.lit(" ("), m["format"], F.lit(")")), F.lit("")))
    return F.array_join(F.transform(matches, one), ",")


def scan_all(tables: dict[str, DataFrame], orders: dict[str, list[str]] | None = None, at_once: int = 4, **options) -> DataFrame:
    """The reports of several tables, with a table column in front. at_once tables are planned side by side, because a small table's scan is mostly waiting for short jobs. orders: order_by of each table."""
    with ThreadPoolExecutor(at_once) as pool:
        reports = list(pool.map(lambda x: scan(x[1], **options, **({"order_by": orders[x[0]]} if orders and x[0] in orders else {})), tables.items()))
    out = None
    for name, one in zip(tables, reports):
        one = one.select(F.lit(name).alias("table"), *one.columns)
        out = one if out is None else out.unionByName(one)
    return out
