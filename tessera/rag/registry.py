"""The datatype registry as a DataFrame: loading, filtering, text for embedding."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import RemoteError
from ..http import Transport, call, over_network

SCHEMA = "id string, name string, doc string, langs array<string>, categories array<string>, country array<string>, examples array<struct<value:string>>, regexp string, classification string"


def load(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; a list's elements may be texts or records with an id. Lines that are no records are left out."""
    raw = spark.read.text(path).select(F.try_parse_json("value").alias("v")).where("v is not null and schema_of_variant(v) like 'OBJECT%'")
    ids = lambda k: F.expr(f"transform(try_variant_get(v, '$.{k}', 'array<variant>'), x -> coalesce(try_variant_get(x, '$.id', 'string'), try_variant_get(x, '$', 'string')))").alias(k)
    text = lambda k: F.expr(f"try_variant_get(v, '$.{k}', 'string')").alias(k)
    examples = F.expr("transform(try_variant_get(v, '$.examples', 'array<variant>'), x -> named_struct('value', coalesce(try_variant_get(x, '$.value', 'string'), try_variant_get(x, '$', 'string'))))").alias("examples")
    return raw.select(text("id"), text("name"), text("doc"), ids("langs"), ids("categories"), ids("country"), examples, text("regexp"), text("classification")).where("id is not null")


def filtered(registry: DataFrame, country: Iterable[str] | None = None, langs: Iterable[str] | None = None, categories: Iterable[str] | None = None) -> DataFrame:
    """Entries that share an element, whatever its case, with each list that is given; an entry without elements shares none."""
    for name, wanted in (("country", country), ("langs", langs), ("categories", categories)):
        if wanted:
            low = [w.lower() for w in wanted]
            registry = registry.where(F.coalesce(F.exists(name, lambda x: F.lower(x).isin(*low)), F.lit(False)))
    return registry


def entry_text() -> Column:
    """What an entry is embedded as: a line for each thing that is known."""
    line = lambda title, c: F.when(c != "", F.concat(F.lit(title + ": "), c))
    words = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", ")
    examples = words(F.slice(F.transform("examples", lambda e: e["value"]), 1, 5))
    return F.concat_ws("\n", line("Datatype", F.coalesce("name", "id")), line("Id", F.col("id")), line("Description", F.col("doc")), line("Categories", words(F.col("categories"))), line("Languages", words(F.col("langs"))), line("Countries", words(F.col("country"))), line("Examples", examples), line("Pattern", F.col("regexp")))


def datatype_dictionary(rules: DataFrame) -> DataFrame:
    """(key, contexts, langs, n_rules): what the rules of each datatype cover together."""
    return rules.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("context")))).alias("contexts"), F.array_sort(F.collect_set("lang")).alias("langs"), F.count("*").alias("n_rules"))


class RegistryClient:
    """A registry of datatypes over HTTP: registry.json holds all of them by id, datatype/<id>.json one. Once loaded, all is answered from memory."""

    def __init__(self, root: str, preload: bool = False, timeout: float = 30.0, transport: Transport = over_network):
        self.root, self.timeout, self.transport = root.rstrip("/"), timeout, transport
        self.loaded: dict | None = None
        if preload:
            self.preload()

    def _ask(self, path: str) -> tuple[int, object]:
        return call("GET", f"{self.root}/{path}", timeout=self.timeout, transport=self.transport)

    def preload(self) -> None:
        status, found = self._ask("registry.json")
        if status >= 400 or not isinstance(found, dict):
            raise RemoteError(f"{self.root}: no registry ({status})")
        self.loaded = found

    def ids(self) -> list[str]:
        if self.loaded is None:
            self.preload()
        return list(self.loaded)

    def has(self, ident: str) -> bool:
        if self.loaded is not None:
            return ident in self.loaded
        return self._ask(f"datatype/{ident}.json")[0] == 200

    def get(self, ident: str) -> dict:
        if self.loaded is not None:
            return self.loaded[ident]
        status, found = self._ask(f"datatype/{ident}.json")
        if status >= 400 or not isinstance(found, dict):
            raise KeyError(ident)
        return found
