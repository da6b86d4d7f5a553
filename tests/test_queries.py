"""The registered queries against their SQL, on the smallest tables where they are there."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from tessera import queries

TABLES = "/root/testdata/sf0.001"
CHEAP = ["profile_customer", "profile_orders", "kind_counts", "flatten_props_json", "rules_stats", "field_rule_text", "data_text_confidence", "ppr_numbers", "date_format_detect", "except_empty_on_off", "report_rows_full", "best_match", "export_merge", "knn_topk", "llm_prompt_text", "hybrid_merge", "registry_text", "rules_list", "rule_dedupe", "rule_filter_country", "datatype_dictionary", "export_min_confidence", "country_code_norm", "knn_filtered_overfetch", "profile_multi_table"]


def shown(v):
    if v is None or v != v:
        return ""
    return str(round(v, 6) if isinstance(v, float) else v).removesuffix(".0")


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = queries.QUERIES[name](spark, TABLES)
    cur = con.execute(queries.SQL[name])
    columns = [c[0] for c in cur.description]
    want = sorted(tuple(shown(r[columns.index(c)]) for c in sorted(columns)) for r in cur.fetchall())
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(shown(r[c]) for c in sorted(columns)) for r in got.collect()) == want


def test_entry_and_names():
    own, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(own) and set(queries.QUERIES) <= set(own)
