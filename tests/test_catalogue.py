"""Every registered query against the SQL that stands beside it, on the smallest tables."""

import math
import os

import duckdb
import pytest

import schemaloom.catalogue as catalogue

#: One query of each kind; the driver runs them all.
CHOSEN = (
    "v_multiple_of v_contains v_format_date_time v_format_ipv6 v_additional v_unevaluated_properties v_one_of v_if_then_else v_disjoint v_invariant v_error_rows v_error_aggregate "
    "v_content_json t_convert t_cast_defaults t_instantiate t_diff t_changeset_apply q_emit_order_nested q_annotated_edges q_lift_nested q_nquads_round_trip q_jsonld_nodes g_two_hop g_union_bag "
    "v_recursive_tree v_recursive_chain v_column_uri_reference t_convert_longs t_decode_branches t_merge q_lift_ordered q_lift_structural q_lift_structural_nested q_jsonld_read q_jsonld_round_trip s_xone_and o_to_schema o_class_expressions x_asof x_range x_error_bursts "
    "g_closure g_subgraph g_class_superclasses r_purchased s_in s_qualified s_and_or_not s_closed i_components i_contradiction x_stream_errors x_cube_profile"
).split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{sf}/{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return None if v is None else str(v)


def test_names_match():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
    assert set(CHOSEN) <= set(catalogue.SQL)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, sf, db, name):
    got = catalogue.QUERIES[name](spark, sf)
    want = db.sql(catalogue.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())
