"""Command line: scan files, folders, databases and collections, list rules, make catalog payloads.

    python -m tessera.cli scan file data.csv --confidence 95
    python -m tessera.cli rules stats
    python -m tessera.cli server run --port 10399

Settings of a .tessera file (see config) stand for options that aren't given.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .errors import ConfigError
from .operators.profile import EMPTY_VALUES
from .plans import emit, export, rules
from .plans.scan import MATCH, MODES, scan, scan_all
from .rag import providers, registry
from .rag.classifier import Classifier, VectorIndex
from .sources import readers, sinks


def words(text: str | None) -> list[str] | None:
    """A list from text parted by commas or full stops."""
    return [w.strip() for w in text.replace(".", ",").split(",") if w.strip()] if text else None


def empty_values(text: str | None) -> tuple[str, ...]:
    """A list from text parted by commas; "" is the empty text, none and null the missing value."""
    if text is None:
        return EMPTY_VALUES
    forms = {'""': "", "none": "None", "null": "None"}
    return tuple(forms.get(w.strip().lower(), w.strip()) for w in text.split(","))


def _classifier(spark: SparkSession, a: argparse.Namespace) -> Classifier | None:
    if a.mode == "rules":
        return None
    if not a.llm_provider or not a.llm_index:
        raise ConfigError("modes llm and hybrid need --llm-provider and --llm-index")
    model = providers.get_provider(a.llm_provider, a.llm_model, a.llm_api_key, a.llm_base_url)
    entries = registry.load(spark, a.llm_registry) if a.llm_registry else None
    return Classifier(model, VectorIndex(spark, a.llm_index), entries)


def _options(a: argparse.Namespace) -> dict:
    if a.confidence is not None and not 0 <= a.confidence <= 100:
        raise SystemExit("--confidence lies between 0 and 100")
    own = rules.load(a.rulepath.split(","), strict=not a.lenient) if a.rulepath else None
    chosen = rules.catalog(own, countries=a.country_codes, strict=not a.lenient) if own or a.country_codes else None
    more = {} if a.confidence is None else {"confidence": a.confidence}
    return more | {"rules": chosen, "limit": a.limit, "contexts": words(a.contexts), "langs": words(a.langs), "stop_on_match": a.stop_on_match, "parse_dates": not a.no_dates, "ignore_imprecise": not a.include_imprecise, "except_empty": not a.include_empty, "fields": a.fields.split(",") if a.fields else None, "stats_only": a.stats_only, "dict_share": a.dict_share, "empty_values": empty_values(a.empty_values), "strict": not a.lenient, "mode": a.mode, "llm_least": a.llm_min_confidence}


def _show(report: DataFrame, a: argparse.Namespace) -> None:
    if not a.stats_only:
        report = sinks.displayed(report, a.format)
        if a.output_format in ("table", "csv"):
            report = sinks.result_rows(report)
    sinks.emit(sinks.document(report, a.output_format, a.pretty, a.indent), None if a.stdout else a.output)


def _remote(spark: SparkSession, a: argparse.Namespace) -> None:
    """The first records of a file, scanned by a server."""
    from .server import scan_remotely

    df = readers.read_file(spark, a.source, None, a.delimiter, a.encoding, a.tagname, None if a.compression == "auto" else a.compression)
    items = [json.loads(r) for r in df.limit(a.limit).toJSON().collect()]  # limit records, as they are sent
    query = {k: v for k, v in (("format", a.format), ("langs", a.langs), ("contexts", a.contexts), ("limit", str(a.limit))) if v}
    got = scan_remotely(a.remote, items, a.retries, a.retry_delay, a.timeout, **query)
    sinks.emit(json.dumps(got, ensure_ascii=False, indent=a.indent if a.pretty else None), None if a.stdout else a.output)


def _tables(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    if a.what == "bulk":
        tables = {}
        for path in readers.list_files(spark, a.source):
            try:
                tables[path] = readers.read_file(spark, path, None, a.delimiter, a.encoding, a.tagname)
            except Exception as e:  # noqa: BLE001 - one file that can't be read doesn't stop the others
                print(f"{path}: {e}")
        return tables
    if a.what == "sql" and a.source.startswith(("duckdb:///", "sqlite:///")):
        return {t: readers.read_embedded(spark, a.source, t, a.limit, a.schema, a.batch_size) for t in readers.embedded_tables(a.source, a.schema)}
    if a.what == "sql":
        return {t: readers.read_table(spark, a.source, t, a.limit, a.batch_size) for t in readers.database_tables(spark, a.source, a.schema)}
    uri = readers.mongo_uri(a.source, a.port, a.user, a.password)
    names = a.collections.split(",") if a.collections else readers.mongo_collections(spark, uri, a.database)
    return {c: readers.read_mongo(spark, uri, a.database, c, a.limit) for c in names}


def _scan(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.remote:
        return _remote(spark, a)
    o = _options(a) | {"classifier": _classifier(spark, a)}
    if a.what == "file":
        df = readers.read_file(spark, a.source, None, a.delimiter, a.encoding, a.tagname, None if a.compression == "auto" else a.compression)
        return _show(scan(df, **o), a)
    if a.what == "bulk":
        a.format = "full"
    if tables := _tables(spark, a):
        _show(scan_all(tables, **o), a)


def _server(spark: SparkSession, a: argparse.Namespace) -> None:
    from .server import server

    print(f"http://{a.host}:{a.port}")
    server(spark, a.host, a.port).serve_forever()


def _index(spark: SparkSession, a: argparse.Namespace) -> None:
    index = VectorIndex(spark, a.source)
    if a.what == "build":
        index.clear()
        index.add(registry.load(spark, a.registry))
    elif a.what == "clear":
        index.clear()
    sinks.emit(str(index.count()))


def _rules(spark: SparkSession, a: argparse.Namespace) -> None:
    own = rules.load(a.rulepath.split(",")) if a.rulepath else None
    r = rules.frame(spark, rules.catalog(own, countries=a.country_codes))
    if a.what == "stats":
        parts = [("type", F.col("type")), ("lang", F.col("lang")), ("context", F.explode("context")), ("country", F.explode_outer("country"))]
        out = None
        for name, c in parts:
            one = r.select(F.lit(name).alias("what"), c.alias("name"))
            out = one if out is None else out.union(one)
        r = out.groupBy("what", "name").agg(F.count("*").alias("n")).orderBy("what", "name")
    sinks.emit(sinks.document(r, a.output_format), a.output)


def _export(spark: SparkSession, a: argparse.Namespace) -> None:
    with open(a.source, encoding="utf8") as f:
        rows = json.load(f)
    if isinstance(rows, dict):
        rows = rows.get("data") or rows.get("fields") or []
    schema = f"key string, ftype string, tags array<string>, matches {MATCH}, labels string, datatype_url string"
    report = spark.createDataFrame([tuple(r.get(k) or ([] if k in ("tags", "matches") else None) for k in "key ftype tags matches labels datatype_url".split()) for r in rows], schema)
    make, target = emit.TARGETS[a.what]
    rows = export.payload(report, a.dataset, target, a.min_confidence, pii_tags=not a.no_pii_tags, datatype_tags=not a.no_datatype_tags, terms=not a.no_terms, properties=not a.no_properties)
    if a.url and not a.dry_run:
        headers = emit.basic(a.user, a.password or "") if a.user else emit.bearer(a.token)
        return sinks.emit(json.dumps(emit.send(rows, make(a.url, headers, a.replace, a.timeout))), a.output)
    sinks.emit(sinks.document(rows, "json", True), a.output)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    top = p.add_subparsers(dest="command", required=True)
    s = top.add_parser("scan")
    s.add_argument("what", choices=("file", "bulk", "sql", "mongodb"))
    s.add_argument("source")
    for name, default in (("delimiter", None), ("encoding", None), ("tagname", None), ("contexts", None), ("langs", None), ("fields", None), ("rulepath", None), ("country-codes", None), ("empty-values", None), ("schema", None), ("database", None), ("collections", ""), ("output", None), ("compression", "auto"), ("remote", None), ("user", None), ("password", None), ("llm-provider", None), ("llm-model", None), ("llm-api-key", None), ("llm-base-url", None), ("llm-index", None), ("llm-registry", None)):
        s.add_argument(f"--{name}", default=default)
    s.add_argument("--mode", default="rules", choices=MODES)
    s.add_argument("--llm-min-confidence", type=float, default=50.0)
    s.add_argument("--port", type=int, default=27017)
    s.add_argument("--retries", type=int, default=0)
    s.add_argument("--retry-delay", type=float, default=1.0)
    s.add_argument("--timeout", type=float)
    s.add_argument("--limit", type=int, default=1000)
    s.add_argument("--batch-size", type=int, default=1000)
    s.add_argument("--confidence", type=float)
    s.add_argument("--dict-share", type=float, default=10.0)
    s.add_argument("--indent", type=int, default=2)
    s.add_argument("--format", default="short")
    s.add_argument("--output-format", default="table", choices=("table", "json", "jsonl", "yaml", "csv"))
    for flag in ("stop-on-match", "no-dates", "include-imprecise", "include-empty", "stats-only", "lenient", "pretty", "stdout"):
        s.add_argument(f"--{flag}", action="store_true")
    s.set_defaults(run=_scan)
    r = top.add_parser("rules")
    r.add_argument("what", choices=("list", "stats"))
    for name, default in (("rulepath", None), ("country-codes", None), ("output", None), ("output-format", "table")):
        r.add_argument(f"--{name}", default=default)
    r.set_defaults(run=_rules)
    e = top.add_parser("export")
    e.add_argument("what", choices=("datahub", "openmetadata", "atlas"))
    e.add_argument("source")
    e.add_argument("dataset")
    e.add_argument("--min-confidence", type=float, default=0.0)
    for name in ("output", "url", "token", "user", "password"):
        e.add_argument(f"--{name}")
    e.add_argument("--timeout", type=float, default=30.0)
    for flag in ("replace", "dry-run", "no-pii-tags", "no-datatype-tags", "no-terms", "no-properties"):
        e.add_argument(f"--{flag}", action="store_true")
    e.set_defaults(run=_export)
    v = top.add_parser("server")
    v.add_argument("what", choices=("run",))
    v.add_argument("--host", default="127.0.0.1")
    v.add_argument("--port", type=int, default=10399)
    v.set_defaults(run=_server)
    i = top.add_parser("index")
    i.add_argument("what", choices=("build", "count", "clear"))
    i.add_argument("source")
    i.add_argument("--registry")
    i.set_defaults(run=_index)
    return p


def settled(argv: list[str] | None, found: dict) -> argparse.Namespace:
    """The options of a command line; settings found in a file stand for those that aren't given, of whatever command has them."""
    p = parser()
    plain = {k.replace("-", "_"): ",".join(map(str, v)) if isinstance(v, list) else v for k, v in found.items()}
    for sub in p._subparsers._group_actions[0].choices.values():
        known = {x.dest for x in sub._actions}
        sub.set_defaults(**{k: v for k, v in plain.items() if k in known})
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    a = settled(argv, config.load())
    a.run(SparkSession.builder.appName("tessera").getOrCreate(), a)


if __name__ == "__main__":
    main()
