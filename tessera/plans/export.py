"""What a metadata catalog is told about each field: tags, terms, properties, as a payload DataFrame, and their merge with what is there."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

PII_CLASSES = "email phone ssn passport creditcard".split()


def best_match(matches: Column) -> Column:
    """The match of the highest confidence, of equal ones the first."""
    top = F.array_max(F.transform(matches, lambda m: m["confidence"]))
    return F.filter(matches, lambda m: m["confidence"] == top)[0]


def is_pii(tags: Column, matches: Column) -> Column:
    return F.coalesce(F.array_contains(tags, "pii"), F.lit(False)) | F.exists(matches, lambda m: m["dataclass"].isin(*PII_CLASSES))


def term(name: Column, style: str) -> Column:
    if style == "urn":
        return F.concat(F.lit("urn:li:glossaryTerm:"), name)
    return F.concat(F.lit("GlossaryTerm."), name)


def capital(name: Column) -> Column:
    """The first letter in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(name, 1, 1)), name.substr(F.lit(2), F.length(name)))


def payload(report: DataFrame, dataset: str, target: str = "urn", min_confidence: float = 0.0, pii_tags: bool = True, datatype_tags: bool = True, terms: bool = True, properties: bool = True) -> DataFrame:
    """(key, address, tags, terms, properties, n_matches) of each field that has anything to tell; n_matches counts the matches that reach min_confidence. target: urn, fqn or qualified."""
    good = F.filter("matches", lambda m: m["confidence"] >= min_confidence)
    address = {"urn": F.concat(F.lit(f"urn:li:schemaField:({dataset},"), F.col("key"), F.lit(")")), "fqn": F.concat(F.lit(dataset + "."), F.col("key")), "qualified": F.concat(F.lit(dataset + "."), F.col("key"))}[target]
    names = F.array_distinct(F.transform(good, lambda m: m["dataclass"]))
    best = best_match(good)
    some = F.size(good) > 0
    none = F.array().cast("array<string>")
    pii = F.when(is_pii(F.col("tags"), F.col("matches")) & F.lit(pii_tags), F.array(F.lit("PII"))).otherwise(none)
    facts = F.map_from_arrays(
        F.array(*map(F.lit, ("confidence", "datatype_url", "datatype", "rule_id", "ftype"))),
        F.array(F.format_string("%.2f", F.bround(best["confidence"], 2)), F.coalesce("datatype_url", F.lit("")), best["dataclass"], best["ruleid"], F.coalesce("ftype", F.lit(""))),
    )
    out = report.select(
        "key",
        address.alias("address"),
        F.array_distinct(F.concat(pii, F.transform(names, capital) if datatype_tags else none)).alias("tags"),
        (F.transform(names, lambda x: term(x, target)) if terms else none).alias("terms"),
        F.when(some & F.lit(properties), facts).alias("properties"),
        F.size(good).alias("n_matches"),
    )
    return out.where((F.size("tags") > 0) | (F.size("terms") > 0) | F.col("properties").isNotNull())


def merged(new: DataFrame, there: DataFrame, mode: str = "append") -> DataFrame:
    """new payload rows over those that are there (same columns), by address. replace: as new; append: what is missing is added, properties overwritten by key; keep: as append, but properties that are there stay."""
    if mode == "replace":
        return new
    old = there.select("address", F.col("tags").alias("o_tags"), F.col("terms").alias("o_terms"), F.col("properties").alias("o_properties"))
    both = new.join(old, "address", "left")
    none = F.array().cast("array<string>")
    a, b = (F.coalesce(c, F.create_map().cast("map<string,string>")) for c in ("properties", "o_properties"))
    first, second = (b, a) if mode == "append" else (a, b)
    props = F.map_concat(F.map_filter(first, lambda k, v: ~F.array_contains(F.map_keys(second), k)), second)
    return both.select("key", "address", F.array_union(F.coalesce("o_tags", none), "tags").alias("tags"), F.array_union(F.coalesce("o_terms", none), "terms").alias("terms"), props.alias("properties"))


def statistics(rows: DataFrame) -> DataFrame:
    """One row: fields, tags, terms and properties that are to be told."""
    return rows.agg(F.count("*").alias("fields"), F.coalesce(F.sum(F.size("tags")), F.lit(0)).alias("tags"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms"), F.count("properties").alias("properties"))


def send(rows: DataFrame, emit: Callable[[Row], None]) -> None:
    """Tell a catalog, from the tasks; a failure of one field doesn't stop the others."""

    def each(part: Iterable[Row]) -> None:
        for r in part:
            try:
                emit(r)
            except Exception as e:  # noqa: BLE001 - whatever a remote catalog raises
                print(f"{r.address}: {e}")

    rows.foreachPartition(each)
