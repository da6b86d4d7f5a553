"""Profiling, rules, scans, sources, sinks, retrieval and payloads."""

import datetime
import json
import math
import re
import tracemalloc
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import cli, queries
from tessera.functions.checks import CHECKS, date_pattern
from tessera.functions.pystr import float_str, python_str, string_kind
from tessera.operators.flatten import extract, first_values, flatten, flatten_json, headers
from tessera.operators.profile import STATS, profile
from tessera.plans import export, rules
from tessera.plans.ppr import RuleError, compile_rule
from tessera.plans.scan import java, scan, scan_all
from tessera.rag import registry, retrieve
from tessera.sources import readers, sinks
from tessera.streaming.profile import drained, running_histogram


def column(spark, values, kind, f):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}").select("k", f(F.col("v")).alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.k)]


# Text forms and kinds


def test_float_text_equals_python(spark):
    values = [0.0, -0.0, 1.5, 0.1, 1e7, 12345678.0, 123456789.125, 1e15, 1e16, 1.25e17, 1e22, 1e-3, 1e-4, 1.5e-4, 1e-5, 2.5e-7, 1e100, -1e16, math.inf, -math.inf, math.nan, 1e300, 2.2250738585072014e-308, 4.35e15, 0.00012345]
    assert column(spark, values, "double", float_str) == [str(v) for v in values]


def test_other_text_forms(spark):
    t = datetime.datetime(2020, 1, 2, 3, 4, 5)
    assert column(spark, [t, t.replace(microsecond=100000)], "timestamp_ntz", lambda c: python_str(c, T.TimestampNTZType())) == ["2020-01-02 03:04:05", "2020-01-02 03:04:05.100000"]
    assert column(spark, [True, False, None], "boolean", lambda c: python_str(c, T.BooleanType())) == ["True", "False", None]


def test_kinds_of_text(spark):
    cases = {"": "empty", " \t": "empty", " ": "empty", "0": "numstr", "007": "numstr", "12": "int", "-5": "float", "1e5": "float", "nan": "float", "Infinity": "float", " 12 ": "float", "1_000": "float", "12f": "str", "1d": "str", "1__0": "str", ".5": "float", "5.": "float", "abc": "str", "²": "str", "2020-01-01": "str"}
    assert column(spark, list(cases), "string", string_kind) == list(cases.values())


# Flattening


def test_flatten_nested(spark):
    df = spark.read.json(spark.sparkContext.parallelize(['{"_id":1,"user":{"id":"7","_id":2},"a":[{"x":1},{"x":2}],"b":[{"y":3}],"tags":["t"],"n":null,"key1":[{"item":"v"}],"e":[]}']))
    got = sorted((r.field, r.value) for r in flatten(df).collect())
    assert got == [("a.x", "1"), ("a.x", "2"), ("b.y", "3"), ("key1.item", "v"), ("n", None), ("user.id", "7")]
    assert [r.x for r in df.select(F.explode(extract(F.col("a"), df.schema["a"].dataType, ["x"])).alias("x")).collect()] == [1, 2]


def test_flatten_map_and_variant(spark):
    m = spark.createDataFrame([({"k": 1, "_id": 2},)], "m map<string,int>")
    assert [(r.field, r.value) for r in flatten(m).collect()] == [("m.k", "1")]
    v = spark.createDataFrame([(1, '{"a":null,"b":{"c":true},"l":[{"d":1},{"d":"x"}]}'), (2, '{"a":"q"}')], "i int, j string").select("i", F.parse_json("j").alias("v"))
    got = sorted((r.field, r.kind, r.value or "") for r in flatten_json(v, "v", ["i"]).collect())
    assert got == [("a", "empty", ""), ("a", "str", "q"), ("b.c", "bool", "True"), ("l.d", "int", "1"), ("l.d", "str", "x")]


def test_headers_see_only_the_first_records(spark):
    v = spark.createDataFrame([(1, '{"a":1}'), (2, '{"b":1}')], "i int, j string").select("i", F.parse_json("j").alias("v"))
    assert [r.field for r in headers(flatten_json(v, "v", ["i"]), 1).collect()] == ["a"]


# Statistics


def stats(df, **o):
    return {r.key: r for r in profile(df, **o).collect()}


def test_statistics(spark):
    df = spark.createDataFrame([(str(i), "active", x, None if i else "", i) for i, x in enumerate(["abc123", "def456", "ghi 789", "jkl", "m", "n", "o", "p", "q", "r"])], "id string, status string, word string, gone string, num int")
    s = stats(df, order_by=["num"])
    assert s["id"].tags == ["uniq"] and s["id"].ftype == "str" and s["id"].share_uniq == 100.0  # "0" is a numstr beside ints
    assert s["status"].is_dictkey and s["status"].tags == ["dict"] and s["status"].dictvalues == ["active"]
    assert (s["word"].minlen, s["word"].maxlen, s["word"].has_digit, s["word"].has_alphas, s["word"].has_special) == (1, 7, 3, 10, 0)
    assert (s["num"].ftype, s["num"].minval, s["num"].maxval, s["num"].has_digit) == ("int", 0.0, 9.0, 0)
    assert s["gone"].ftype == "str" and s["gone"].n_uniq == 2 and (s["gone"].minlen, s["gone"].maxlen) == (0, 4)
    assert set(STATS) == set(profile(df).columns)


def test_statistics_leave_out_short_and_numbered_fields(spark):
    df = spark.createDataFrame([(1, 2, 3)], "x int, `12` int, ok int")
    assert set(stats(df)) == {"ok"}
    assert profile(df.limit(0)).count() == 0


def test_row_order_and_partitions_do_not_matter(spark):
    df = spark.range(500).selectExpr("id as num", "cast(id % 7 as string) as few", "if(id % 3 = 0, null, id * 1.5) as x")
    a, b = (stats(d, order_by=["num"]) for d in (df, df.repartition(5).orderBy(F.rand(3))))
    assert a == b


# Rules


PPR = [
    ("Word(nums)", {"1": True, " 12": True, "1\n2": True, "1a": False, "": False}),
    ("('1' + Word(nums, exact=3)) ^ ('2' + Word('10', max=1) + Word(nums, exact=2))", {"1999": True, "2019": True, "2999": False, "1 999": True, "19999": False}),
    ('Word(printables) + "latitude"', {"geo latitude": True, "geo_latitude": False, "geolatitude": False}),
    ("Optional(Word(printables)) + Literal('year')", {"year": False, "my year": True, "my_year": False}),
    ("CaselessLiteral('is') + Optional('_') + Optional(Word(printables))", {"is_x": True, "IS": True, "island": True, "this": False}),
    ("Word(alphanums) + Optional('_') + CaselessLiteral('flag')", {"x_flag": True, "x FLAG": True, "xflag": False}),
    ("Word(nums, exact=3) + Literal('/').suppress() + Word(nums, max=2)", {"123/4": True, "123/456": False, "12/34": False, "123 / 45": True}),
    ('"phone" + lineEnd', {"phone": False, "phone\n": True}),
    ("Word(alphas, max=2) + ' ' + Word(alphas, max=2)", {"ab cd": False, "abcd": False}),
    ("Literal('10.') + Word(nums, exact=4) + '/' + Word(printables)", {"10.1234/x": True, "10.123/x": False}),
]


@pytest.mark.parametrize("rule,cases", PPR)
def test_rules_as_patterns(spark, rule, cases):
    pattern = compile_rule(rule)
    assert column(spark, list(cases), "string", lambda v: v.rlike(pattern)) == list(cases.values())
    assert [java(pattern).search(x) is not None for x in cases] == list(cases.values())


def test_lenient_rules_and_bad_ones():
    assert java(compile_rule('"phone" + lineEnd', False)).search("phone")
    for bad in ("__import__('os')", "Word(", "open('x')", "Word(nums).foo()", "1 + 2"):
        with pytest.raises(RuleError):
            compile_rule(bad)


def test_catalog_filters():
    all_ = rules.catalog()
    assert len(all_) == len({r.id for r in all_}) == 139
    assert {r.lang for r in rules.catalog(langs=["fr"])} == {"fr"}
    assert [r.country for r in rules.catalog(countries="US")] == [("us",)]
    assert rules.catalog(countries="ca") == []
    assert all(not r.imprecise for r in rules.applicable(all_, "data")) and any(r.imprecise for r in rules.applicable(all_, "data", ignore_imprecise=False))
    assert rules.country_codes("US; ca ,,Ru") == ("us", "ca", "ru") and rules.country_codes(None) == ()


def test_written_rules(tmp_path, spark):
    (tmp_path / "a.yaml").write_text("name: g\ndescription: d\nlang: en\ncontext: x.y\ncountry_code: us\nrules:\n  r1:\n    key: k1\n    type: field\n    match: text\n    rule: 'Alpha,be'\n  r2:\n    key: k2\n    type: data\n    match: ppr\n    rule: Word(nums\n  r3:\n    key: k3\n    type: data\n    match: func\n    rule: some.where.even\n  r4:\n    key: k4\n    type: data\n    match: ppr\n    rule: Word(nums)\n    minlen: 1\n    fieldrule: gate,code\n    fieldrulematch: text\n    validator: some.where.even\n")
    assert [r.id for r in rules.load([tmp_path])] == ["r1", "r4"]
    rules.register_check("even", lambda v: v.rlike("[02468]$"))
    own = rules.load([tmp_path])
    assert [r.id for r in own] == ["r1", "r3", "r4"] and own[0].keywords == {"alpha", "be"} and (own[0].minlen, own[0].maxlen) == (2, 5) and own[0].context == ("x", "y")
    df = spark.createDataFrame([("2",), ("4",), ("5",)], "code string")
    got = {m.ruleid: m.confidence for r in scan(df, own, confidence=50).collect() for m in r.matches}
    assert got == {"r4": pytest.approx(200 / 3)}


# Scans


def test_scan_golden(spark):
    df = spark.createDataFrame([(str(i), n) for i, n in enumerate("John Mary Michael Anna Orban Lucy".split(), 1)], "id string, name string")
    r = {x.key: x for x in scan(df).collect()}
    assert r["id"].labels == "id 100.00" and r["name"].labels == "name 100.00" and r["id"].ftype == "int"
    assert r["id"].datatype_url.endswith("/id") and (r["id"].minval, r["id"].maxval) == (1.0, 6.0)


def test_scan_users(spark):
    u = "8c5f4f0e-1111-4a2b-9c3d-123456789abc"
    df = spark.createDataFrame([(1, "Ann", "a@b.co", datetime.date(2020, 1, 1), u, "555", True, "2020-01-02")], "id int, name string, email string, created_at date, uuid string, phone string, ok boolean, stamp string")
    r = {x.key: [(m.ruleid, m.dataclass) for m in x.matches] for x in scan(df).collect()}
    assert ("_int_fieldtype_date", "date") in r["created_at"] and ("_int_fieldtype_boolean", "boolean") in r["ok"]
    assert [m[1] for m in r["uuid"]] == ["uuid", "uuid"] and r["stamp"] == [("qddate", "datetime")]
    assert r["email"][0][1] == "email" and r["phone"][0][1] == "phone"
    assert scan(df, parse_dates=False).where("key = 'stamp'").first().labels == ""
    assert {x.key: len(x.matches) for x in scan(df, stop_on_match=True).collect()}["uuid"] == 2


def test_scan_options(spark):
    df = spark.createDataFrame([("true",), ("no",), (None,), ("",), ("true",)], "v1 string")
    full = scan(df, confidence=60).first()
    assert [(m.dataclass, m.confidence) for m in full.matches] == [("boolean", pytest.approx(200 / 3))]
    assert scan(df, confidence=60, except_empty=False).first().matches == []
    assert scan(df, confidence=100).first().matches == []
    assert scan(df, stats_only=True).columns == list(STATS)
    assert scan(df, langs=["ru"]).first().matches == []
    # Beside a missing value an empty text makes the lengths unknown: they count as 4, so rules for 4 letters apply.
    odd = spark.createDataFrame([("true",), (None,), ("",)], "v1 string")
    assert [m.dataclass for m in scan(odd, confidence=60).first().matches] == ["boolean"]
    with pytest.raises(KeyError):
        scan(df, fields=["nope"])
    assert [r.key for r in scan_all({"a": df, "b": df}).select("table", "key").collect()] == ["v1", "v1"]


def test_checks_and_dates(spark):
    assert column(spark, ["https://a.b/c?d", "http://localhost:80/", "a.b", "http://", "http://a b.c"], "string", CHECKS["url"]) == [True, True, False, False, False]
    assert column(spark, ["a.bc", "a-b.co.uk", "-a.bc", "a", "a..b"], "string", CHECKS["domain"]) == [True, True, False, False, False]
    cases = {"2020-01-31": "iso_date", "31.12.2020": "dmy_dot", "12/31/2020": "mdy_slash", "31/12/2020": "dmy_slash", "5 May 2020": "d_month_y", "5 мая 2020": "d_month_y_ru", "2020-13-01": None, "x": None, "2020.1.2 10:15": "ymd_dot_any_minutes", "3. Mai 2021": "d_month_y_fr_any", "3. März 2021": "d_month_y_de_any", "3 de mayo de 2021": "d_month_y_es_any", "5/6/21": "dmy_slash_short", "2021-W05": "iso_week", "Sept 2020": "month_y", "20200131": "ymd_compact", "05.06.2020 10:11:12": "dmy_dot_time", "Mon, 5 Jan 2020 10:11:12 +0000": "rfc822"}
    assert column(spark, list(cases), "string", date_pattern) == list(cases.values())


# Sources and sinks


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;name\n1;"x;y"\n2;\n', "utf-8")
    assert [tuple(r) for r in readers.read_file(spark, str(tmp_path / "a.csv")).orderBy("id").collect()] == [("1", "x;y"), ("2", "")]
    (tmp_path / "b.csv").write_bytes("имя,город\nИван,Омск\n".encode("windows-1251"))
    assert readers.read_file(spark, str(tmp_path / "b.csv")).columns == ["имя", "город"]
    (tmp_path / "c.jsonl").write_text('{"a":1}\n{"b":2}\n')
    assert readers.read_file(spark, str(tmp_path / "c.jsonl")).count() == 2
    assert sorted(r.field for r in flatten_json(readers.read_ragged(spark, str(tmp_path / "c.jsonl")), "v").collect()) == ["a", "b"]
    (tmp_path / "d.xml").write_text('<r><book k="1"><t l="e">A</t></book><book k="2"><t l="f">B</t></book></r>')
    x = readers.read_file(spark, str(tmp_path / "d.xml"))
    assert {r.field for r in flatten(x).collect()} == {"@k", "t.@l", "t.#text"}
    with zipfile.ZipFile(tmp_path / "e.csv.zip", "w") as z:
        z.writestr("e.csv", "p,q\n1,2\n")
    assert readers.read_file(spark, str(tmp_path / "e.csv.zip")).first().asDict() == {"p": "1", "q": "2"}
    bson = b"\x16\x00\x00\x00\x02hello\x00\x06\x00\x00\x00world\x00\x00"
    (tmp_path / "f.bson").write_bytes(bson)
    assert [(r.field, r.value) for r in flatten_json(readers.read_file(spark, str(tmp_path / "f.bson")), "v").collect()] == [("hello", "world")]
    names = [p.rsplit("/", 1)[-1] for p in readers.list_files(spark, str(tmp_path))]
    assert names == ["a.csv", "b.csv", "c.jsonl", "d.xml", "e.csv.zip", "f.bson"]
    with pytest.raises(readers.FormatError):
        readers.read_file(spark, str(tmp_path / "none.what"))


def test_format_helpers():
    assert readers.file_format("x/y.CSV.gz") == ("csv", "gz") and readers.file_format("a.b") == (None, None) and readers.is_supported("a.parquet")
    assert readers.delimiter_of("a,b;c;d") == ";" and readers.delimiter_of("abc") == ","
    for name in ("windows-1251", "koi8-r", "cp866"):
        assert readers.encoding_of("привет, как дела сегодня".encode(name)) == name
    assert readers.encoding_of("café à la crème, niño".encode("latin-1")) == "iso-8859-1" and readers.encoding_of("a b".encode("utf-16le")) == "utf-16le"
    assert readers.column_names(["a", "", "a"]) == ["a", "col_1", "a_2"]
    assert readers.spans_lines('a,b\n"x\ny",1\n', ",") and not readers.spans_lines('a,b\nx"y,1\n', ",")
    assert readers.encoding_of("é".encode()[:1] + b"") == "utf-8" and readers.encoding_of("привет".encode("cp1251")) == "windows-1251"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1",)], "id string")
    r = scan(df)
    assert json.loads(sinks.document(sinks.result_rows(r)))[0]["labels"] == "id 100.00"
    assert "id 100.00" in sinks.document(sinks.result_rows(r), "csv") and "id 100.00" in sinks.document(sinks.result_rows(r), "yaml") and "id 100.00" in sinks.document(sinks.result_rows(r), "table")
    assert [json.loads(x)["key"] for x in sinks.document(r, "jsonl").splitlines()] == ["id"]
    sinks.write(r, str(tmp_path / "o"), "csv")
    assert spark.read.csv(str(tmp_path / "o"), header=True).first().tags == "uniq"
    assert sinks.displayed(scan(df.withColumnRenamed("id", "zz"))).count() == 0


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n")
    cli.main(["scan", "file", str(tmp_path / "a.csv"), "--output-format", "json", "--output", str(tmp_path / "r.json")])
    assert {r["key"]: r["labels"] for r in json.loads((tmp_path / "r.json").read_text())} == {"id": "id 100.00", "name": "name 100.00"}
    cli.main(["export", "datahub", str(tmp_path / "r.json"), "ds"])
    assert "urn:li:schemaField:(ds,id)" in capsys.readouterr().out
    cli.main(["rules", "stats"])
    assert re.search(r"lang\s+fr\s+11", capsys.readouterr().out)


# Retrieval, payloads, streams


def test_registry_and_model(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"name":"E-mail","id":"email","langs":[{"id":"en"}],"country":["US"],"examples":[{"value":"a@b"}]}\nnot json\n{"id":"asn","categories":["net"]}\n')
    reg = registry.load(spark, str(tmp_path / "r.jsonl"))
    assert {r.id for r in reg.collect()} == {"email", "asn"} and [r.id for r in registry.filtered(reg, country=["us"], langs=["EN"]).collect()] == ["email"]
    texts = reg.select("id", registry.entry_text().alias("text"))
    index = retrieve.embedded(texts, "text")
    near = retrieve.nearest(index.selectExpr("id as query_id", "embedding"), index, 1)
    assert {(r.query_id, r.id) for r in near.collect()} == {("email", "email"), ("asn", "asn")}

    def broken(texts):
        raise RuntimeError

    assert sum(retrieve.embedded(texts, "text", broken).first().embedding) == 0
    asked = retrieve.asked(texts.withColumn("prompt", F.col("id")), lambda q: '{"datatype_id": "%s", "confidence": 0.8}' % q, delay=0)
    assert {r.a.datatype_id for r in asked.select(retrieve.answer(F.col("response")).alias("a")).collect()} == {"email", "asn"}


def test_payload_merge(spark):
    df = spark.createDataFrame([("a@b.c", "x")], "email string, other string")
    p = export.payload(scan(df, parse_dates=False), "db.t", "fqn")
    row = p.where("key = 'email'").first()
    assert row.address == "db.t.email" and row.tags[:2] == ["PII", "Email"] and row.properties["datatype"] == "email"
    there = spark.createDataFrame([("db.t.email", ["Mine"], ["t"], {"rule_id": "old", "mine": "1"})], "address string, tags array<string>, terms array<string>, properties map<string,string>")
    kept = export.merged(p, there, "keep").where("key = 'email'").first()
    assert kept.tags[0] == "Mine" and kept.properties["rule_id"] == "old"
    assert export.merged(p, there, "append").where("key = 'email'").first().properties["rule_id"] != "old"
    assert export.merged(p, there, "replace").where("key = 'email'").first().tags == row.tags
    assert export.statistics(p).first().fields == p.count()


def test_stream(spark, tmp_path):
    spark.createDataFrame([("x", 1), ("x", 2), (None, 3)], "w string, n int").write.parquet(str(tmp_path / "s"))
    s = spark.readStream.schema("w string, n int").parquet(str(tmp_path / "s"))
    assert {(r.field, r.value, r.cnt) for r in drained(spark, running_histogram(s)).where("field = 'w'").collect()} == {("w", "x", 2), ("w", None, 1)}


def test_server_and_client(spark):
    import threading

    from tessera.errors import RemoteError
    from tessera.server import scan_remotely, server

    s = server(spark, port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{s.server_address[1]}"
    got = scan_remotely(root, [{"id": "1", "x1": "q"}, {"id": "2"}], limit="10")
    assert [r["labels"] for r in got["results"]] == ["id 100.00"] and {r["key"] for r in got["stats"]} == {"id", "x1"}
    with pytest.raises(RemoteError):
        scan_remotely(root, {"no": "list"})
    s.shutdown()
    with pytest.raises(RemoteError):
        scan_remotely("http://127.0.0.1:9", [], retries=1, delay=0, timeout=1)


def test_settings(tmp_path):
    from tessera import config
    from tessera.errors import ConfigError

    assert config.load([tmp_path]) == {}
    (tmp_path / ".tessera").write_text(f"rulepath: {tmp_path}\nlangs: en, ru\n")
    assert config.load([tmp_path]) == {"rulepath": [str(tmp_path)], "langs": ["en", "ru"]}
    (tmp_path / ".tessera").write_text("rulepath: /none/such\n")
    with pytest.raises(ConfigError):
        config.load([tmp_path])


def test_shapes():
    from tessera.functions.shapes import pattern

    assert pattern("AA-99.a") == r"^[A-Z]{2}\-[0-9]{2}\.[a-z]$"


def test_csv_keeps_every_record(spark, tmp_path):
    rows = 'id,name\n1,"x\ny"\nid,name\n2,\n'
    (tmp_path / "a.csv").write_text(rows)
    want = [("1", "x\ny"), ("2", ""), ("id", "name")]
    assert sorted(tuple(r) for r in readers.read_file(spark, str(tmp_path / "a.csv")).collect()) == want
    with zipfile.ZipFile(tmp_path / "b.csv.zip", "w") as z:
        z.writestr("b.csv", rows)
    assert sorted(tuple(r) for r in readers.read_file(spark, str(tmp_path / "b.csv.zip")).collect()) == want
    (tmp_path / "c.csv").write_bytes("имя,город\nИван,Омск\nимя,город\nкороткая\n".encode("koi8-r"))
    assert readers.read_file(spark, str(tmp_path / "c.csv")).count() == 3


def test_embedded_databases(spark, tmp_path):
    import sqlite3

    import duckdb

    at = str(tmp_path / "a.db")
    with sqlite3.connect(at) as con:
        con.execute("create table users (id integer, name text, score real, raw text)")
        con.execute("insert into users values (1, 'Ann', 1.5, cast(x'ff41' as text)), (2, null, 2, 'ok')")
        con.execute("create table empty_table (id integer)")
    url = f"sqlite:///{at}"
    assert readers.embedded_tables(url) == ["empty_table", "users"]
    u = readers.read_embedded(spark, url, "users")
    assert [f.dataType.simpleString() for f in u.schema] == ["bigint", "string", "double", "string"] and u.orderBy("id").first().raw == "\ufffdA"
    assert readers.read_embedded(spark, url, "users", limit=1).count() == 1 and readers.read_embedded(spark, url, "empty_table").count() == 0
    duck, copy = str(tmp_path / "d.duckdb"), str(tmp_path / "copy.db")
    with duckdb.connect(duck) as con:
        con.execute("create table products as select 7 as product_id, 'pen' as product_name, 1.25::decimal(10,2) as price, date '2020-01-02' as made")
    p = readers.read_embedded(spark, f"duckdb:///{duck}", "products")
    assert {x.key: x.labels for x in scan(p).collect()}["made"] == "date 100.00"
    assert readers.copy_to_sqlite(duck, copy) == {"products": 1} and readers.read_embedded(spark, f"sqlite:///{copy}", "products").first().product_name == "pen"


class Answers:
    """A transport that answers from a function and remembers what it was asked."""

    def __init__(self, answer):
        self.answer, self.asked = answer, []

    def __call__(self, method, url, headers, body, timeout):
        self.asked.append((method, url, headers, json.loads(body) if body else None))
        status, out = self.answer(method, url, self.asked[-1][3])
        return status, json.dumps(out).encode()


def test_providers():
    from tessera.errors import ConfigError, RemoteError
    from tessera.rag import providers

    net = Answers(lambda *a: (200, {"choices": [{"message": {"content": "{}"}}]}))
    assert providers.get_provider("OpenAI", api_key="k", transport=net)("q") == "{}"
    method, url, headers, body = net.asked[0]
    assert url.endswith("/chat/completions") and headers["Authorization"] == "Bearer k" and body["response_format"] == {"type": "json_object"} and body["temperature"] == 0.0
    assert providers.get_provider("perplexity", api_key="k", transport=net)("q") == "{}" and "response_format" not in net.asked[1][3]
    local = Answers(lambda *a: (200, {"message": {"content": "x"}}))
    assert providers.get_provider("ollama", model="m", transport=local)("q") == "x" and local.asked[0][3] | {"messages": 0} == {"model": "m", "messages": 0, "stream": False, "format": "json"}
    with pytest.raises(RemoteError):
        providers.get_provider("lmstudio", transport=Answers(lambda *a: (500, {})))("q")
    with pytest.raises(ConfigError):
        providers.get_provider("nobody")
    providers.register_provider("mine", lambda **o: lambda q: "own")
    assert "mine" in providers.list_providers() and providers.get_provider("mine")("q") == "own"


def test_index_and_modes_of_a_scan(spark, tmp_path):
    from tessera.rag.classifier import Classifier, VectorIndex

    (tmp_path / "r.jsonl").write_text('{"id":"email","name":"E-mail","langs":["en"],"categories":["pii"]}\n{"id":"zodiac","name":"Zodiac sign","langs":["en"]}\n')
    entries = registry.load(spark, str(tmp_path / "r.jsonl"))
    index = VectorIndex(spark, str(tmp_path / "index"))
    assert index.count() == 0 and index.all() is None

    def model(prompt):
        assert "Zodiac" in prompt
        return '{"datatype_id": "zodiac", "confidence": 0.9}' if "Field name: sign" in prompt else '{"datatype_id": "email", "confidence": 0.3}'

    c = Classifier(model, index, entries, delay=0)
    assert index.count() == 2 and index.get(["zodiac"]).count() == 1
    index.add(entries)
    assert index.count() == 2  # the same ids again
    q = retrieve.embedded(spark.createDataFrame([("q", "Zodiac sign")], "query_id string, t string"), "t").select("query_id", "embedding")
    assert index.search(q, 1).first().id == "zodiac" and [r.id for r in index.search(q, 2, categories=["PII", "x"]).collect()] == ["email"]
    assert c.classify_field("sign", ["leo"])["datatype_id"] == "zodiac"
    df = spark.createDataFrame([("leo", "7"), ("virgo", "8")], "sign string, id string")
    of = lambda **o: {r.key: [(m.ruleid, m.dataclass, m.confidence) for m in r.matches] for r in scan(df, parse_dates=False, **o).collect()}
    assert of(mode="hybrid", classifier=c) == {"id": [("uniqueidbyknown", "id", 100.0)], "sign": [("llm_classifier", "zodiac", 90.0)]}
    assert of(mode="llm", classifier=c) == {"id": [("llm_classifier", "email", pytest.approx(30.0))], "sign": [("llm_classifier", "zodiac", 90.0)]}
    assert of(mode="llm") == of()
    with pytest.raises(ValueError):
        scan(df, mode="magic")
    index.clear()
    assert index.count() == 0


def test_emitters():
    from pyspark.sql import Row

    from tessera.plans import emit

    row = Row(key="mail", address="db.t.mail", tags=["PII", "Email"], terms=["GlossaryTerm.email"], properties={"rule_id": "r"})
    net = Answers(lambda *a: (200, {}))
    emit.DataHub("http://h", emit.bearer("t"), transport=net).emit(row)
    assert [a[3]["proposal"]["aspectName"] for a in net.asked] == ["globalTags", "glossaryTerms", "schemaFieldProperties"] and net.asked[0][2]["Authorization"] == "Bearer t"
    table = {"id": "1", "columns": [{"name": "x"}, {"name": "mail", "tags": [{"tagFQN": "Tag.PII"}], "extension": {"a": 1}}]}
    net = Answers(lambda m, url, b: (200, table))
    emit.OpenMetadata("http://o/api", transport=net).emit(row)
    patch = net.asked[1][3]
    assert net.asked[1][0] == "PATCH" and [t["tagFQN"] for t in patch[0]["value"]] == ["Tag.PII", "Tag.Email", "GlossaryTerm.email"] and patch[1]["value"] == {"a": 1, "rule_id": "r"}
    with pytest.raises(Exception, match="no table"):
        emit.OpenMetadata("http://o", transport=Answers(lambda *a: (404, {}))).emit(row)

    def atlas(method, url, body):
        if "uniqueAttribute" in url:
            return 200, {"entity": {"guid": "g"}}
        if url.endswith("/classifications") and method == "GET":
            return 200, {"list": [{"typeName": "PII"}]}
        return 200, {"entity": {"guid": "g", "attributes": {"name": "n", "tessera_old": "1"}}}

    for replace, want in ((False, {"name": "n", "tessera_old": "1", "tessera_rule_id": "r"}), (True, {"name": "n", "tessera_rule_id": "r"})):
        net = Answers(atlas)
        emit.Atlas("http://a", emit.basic("u", "p"), replace, transport=net).emit(row)
        assert [a[3]["classification"]["typeName"] for a in net.asked if a[0] == "POST"] == ["Email"]
        assert next(a[3] for a in net.asked if a[0] == "PUT")["entity"]["attributes"] == want


def test_send_counts_what_was_tried(spark):
    from tessera.plans import emit

    class Fails(emit.Emitter):
        def emit(self, row):
            if row.key == "b":
                raise RuntimeError("no")

    df = spark.createDataFrame([("a", "a", ["x"], [], None), ("b", "b", ["y", "z"], ["t"], {"k": "v"})], "key string, address string, tags array<string>, terms array<string>, properties map<string,string>")
    assert emit.send(df, Fails("http://x")) == {"fields": 2, "tags": 3, "terms": 1, "properties": 1, "errors": 1}


def test_registry_client():
    from tessera.rag.registry import RegistryClient

    def answer(method, url, body):
        if url.endswith("registry.json"):
            return 200, {"email": {"id": "email"}}
        return (200, {"id": "asn"}) if url.endswith("/datatype/asn.json") else (404, None)

    c = RegistryClient("http://r/", transport=Answers(answer))
    assert c.has("asn") and not c.has("zz") and c.get("asn") == {"id": "asn"}
    assert c.ids() == ["email"] and c.has("email") and not c.has("asn")


def test_name_functions_and_validators(spark, tmp_path):
    from tessera.functions import checks

    (tmp_path / "a.yaml").write_text("name: g\ndescription: d\nlang: en\ncontext: x\nrules:\n  r1:\n    key: dom\n    type: field\n    match: func\n    rule: some.where.domain\n")
    own = rules.load([tmp_path])
    df = spark.createDataFrame([("x",)], "`a.bc` string").withColumnRenamed("a.bc", "plain")
    assert scan(df, own, parse_dates=False).first().matches == []
    assert checks.holds("domain", "a.bc") and not checks.holds("domain", "plain")
    asn = {"AS15169": True, "0": False, "23456": False, "64512": False, "131072": True, "4294967295": False, "x": False}
    assert column(spark, list(asn), "string", CHECKS["validate_asn"]) == list(asn.values())
    tags = {"en": True, "en-GB": True, "zh-Hant-TW": True, "e": False, "en_GB": False}
    assert column(spark, list(tags), "string", CHECKS["validate_language_tag"]) == list(tags.values())


def test_settings_stand_for_options():
    a = cli.settled(["scan", "file", "x.csv", "--limit", "5"], {"rulepath": ["p", "q"], "limit": 9, "langs": ["en", "ru"], "min-confidence": 3})
    assert a.rulepath == "p,q" and a.limit == 5 and a.langs == "en,ru" and a.mode == "rules"
    assert cli.settled(["export", "atlas", "r.json", "ds"], {"min-confidence": 3}).min_confidence == 3
    assert cli.settled(["server", "run"], {}).port == 10399


def test_patterns_of_samples(spark):
    from tessera.functions.shapes import induced

    df = spark.createDataFrame([(x,) for x in ("AB-1", "AB-22", "CD-333", "CD-4", "x.y")], "v string")
    got = {r.pattern: r.n for r in induced(df, "v").collect()}
    assert got == {r"^(?:AB|CD)\-[0-9]{1,3}$": 4, r"^[a-z]\.[a-z]$": 1}
    assert all(any(re.match(p, x) for p in got) for x in ("AB-1", "CD-333", "x.y"))


def _brute(q, v, n):
    d = ((q[:, None, :].astype(float) - v[None, :, :].astype(float)) ** 2).sum(2)
    return {(i, int(j), r) for i, one in enumerate(d) for r, j in enumerate(np.lexsort((np.arange(len(v)), one))[:n], 1)}


def _vectors(seed=5):
    """Vectors far from zero, whose products cancel, some of them doubled and one very large."""
    v = (np.random.default_rng(seed).normal(size=(5000, 8)) + 300).astype(np.float32)
    v[1000:1200] = v[:200]
    v[2000:2030] = v[7]
    v[4999] = 1e18
    return v


def test_nearest_holds_a_tile_at_a_time():
    v = np.random.default_rng(3).normal(size=(150_000, 4)).astype(np.float32)
    q = v[:512].astype(np.float64)
    tracemalloc.start()
    t = retrieve._nearest(q, pa.array(range(len(v))), v, pa.array([True] * len(v)), 5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6, most  # all distances of 512 queries would be 614 MB
    rank = np.arange(len(t)) - np.searchsorted(t.column("row").to_numpy(), t.column("row").to_numpy()) + 1
    assert {(r, i, k) for r, i, k in zip(t.column("row").to_pylist(), t.column("item").to_pylist(), rank) if r < 20} == _brute(q[:20], v, 5)


def test_nearest_equals_brute_force(spark):
    v = _vectors()
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<float>")
    got = retrieve.nearest(df.where("id < 300 or id = 4999").withColumnRenamed("id", "query_id"), df, 5, block_bytes=200_000)
    want = {(i if i < 300 else 4999, j, r) for i, j, r in _brute(v[[*range(300), 4999]], v, 5)}
    assert {(r.query_id, r.id, r.rank) for r in got.collect()} == want


def test_nearest_with_a_condition_equals_brute_force(spark):
    v = _vectors(6)[:1000]
    df = spark.createDataFrame([(i, x.tolist(), i % 3 if i % 7 else None) for i, x in enumerate(v)], "id long, embedding array<float>, label int")
    got = retrieve.nearest(df.where("id < 100").withColumnRenamed("id", "query_id"), df, 2, keep=F.col("label") < 1, block_bytes=50_000)
    want = {}
    for i, j, r in sorted(_brute(v[:100], v, 6), key=lambda x: x[2]):
        if j % 7 and j % 3 == 0 and len(want.setdefault(i, [])) < 2:
            want[i].append(j)
    assert {(r.query_id, r.id, r.rank) for r in got.collect()} == {(i, j, k) for i, js in want.items() for k, j in enumerate(js, 1)}


def test_nearest_holds_a_tile_of_equal_entries():
    v = np.ones((60_000, 4), np.float32)
    tracemalloc.start()
    t = retrieve._nearest(np.ones((64, 4)), pa.array(range(len(v))[::-1]), v, pa.array([True, False] * 30_000), 15)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6, most
    assert t.column("item").to_pylist() == [*range(15)] * 64 and t.column("keep").to_pylist() == ([False, True] * 8)[:15] * 64


def test_first_values_of_a_flat_table_need_no_sort(spark):
    df = spark.range(500).selectExpr("(id * 7) % 500 as k", "if(id % 3 = 0, null, id) as n", "cast(id as string) as t")
    got = queries.first_cells(df, 20, ["k"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "TakeOrderedAndProject" in plan
    assert {(r.pos.k, r.field, r.value) for r in got.collect()} == {(r.pos.k, r.field, r.value) for r in first_values(flatten(df, ["k"]), 20).collect()}
    nested = spark.createDataFrame([(k, [] if k < 5 else [(k,)]) for k in range(9)], "k int, x array<struct<y:int>>")
    assert {(r.field, r.value) for r in queries.first_cells(nested, 2, ["k"]).collect()} == {("k", "0"), ("k", "1"), ("x.y", "5"), ("x.y", "6")}


def test_headers_of_a_table_cut_the_records_first(spark):
    df = spark.range(3000).selectExpr("3000 - id as k", "id as n", "cast(id as string) as t")
    got = queries.first_headers(df, 1000, ["k"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("TakeOrderedAndProject") == 1 and "Join" not in plan
    assert sorted((r.ord, r.field) for r in got.collect()) == [(1, "k"), (2, "n"), (3, "t")]
    nested = spark.createDataFrame([(k, {"late": k} if k == 1000 else {"soon": k}) for k in range(1001)], "k int, m map<string,int>")
    assert {r.field for r in queries.first_headers(nested, 1000, ["k"]).collect()} == {"k", "m.soon"}


def test_value_rules_hold_no_table_of_values(spark):
    long = spark.range(300).selectExpr("'f' as field", "if(id % 3 = 0, null, md5(cast(id as string))) as value")
    got = queries._confidences(long.union(long), [r for r in queries._RULES if r.id == "md5hash"])
    keys = re.findall(r"HashAggregate\(keys=\[(.*?)\]", got._jdf.queryExecution().executedPlan().toString())
    assert keys and not any("value" in k for k in keys)
    assert [tuple(r) for r in got.collect()] == [("f", "md5hash", 100.0)]
