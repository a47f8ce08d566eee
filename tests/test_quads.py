"""Quads as text and back, numbers as text, documents that may not become quads, streams with late rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from schemaloom.catalogue import graphs
from schemaloom.functions.formats import is_regex
from schemaloom.functions.hashing import hash_column, hash_text
from schemaloom.functions.numbers import number_text
from schemaloom.operators import quads as Q
from schemaloom.operators import selection
from schemaloom.operators.validation import row_value
from schemaloom.plans.compiler import Compiler
from schemaloom.plans.registry import Registry
from schemaloom.plans.values import Variant
from schemaloom.streaming import validation as S

NUMBERS = [(0.0, "0"), (-0.0, "0"), (1.5, "1.5"), (1e15, "1000000000000000"), (1.2345678901234568e20, "123456789012345680000"), (1e21, "1e+21"), (1.5e-7, "1.5e-7"), (1e-7, "1e-7"), (0.000001, "0.000001"), (0.00012, "0.00012"), (12345678.25, "12345678.25"), (-0.5, "-0.5")]


def test_numbers_print_as_javascript_prints_them(spark):
    got = spark.createDataFrame([(x,) for x, _ in NUMBERS], "x double").select(number_text(F.col("x"))).collect()
    assert [r[0] for r in got] == [t for _, t in NUMBERS]


@pytest.mark.parametrize("text", ["", "abc", "é€", "a\U0001f600b", "x" * 300])
def test_hash_of_a_column_is_that_of_the_text(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(hash_column(F.col("t"))).first()[0] == hash_text(text)


def lines(spark, *texts):
    return spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "value string, ord long")


def test_nquads_of_every_kind(spark):
    given = lines(spark, '<s> <p> "a\\tb\\\\n\\u00e9\\U0001F600\\"" .', "# nothing", "", "_:a <p> _:b <g> .", '<s> <p> "x"@en-GB _:g . # said', "<< <s> <p> _:o >> <q> <r> .", '<s\\u0020t> <p> "5"^^<d> .')
    rows = Q.parse_nquads(given).orderBy("ord").collect()
    assert [r["o"] for r in rows] == ['a\tb\\né\U0001f600"', "_:b", "x", "r", "5"]
    assert [(r["s_kind"], r["g"]) for r in rows] == [("iri", None), ("bnode", "g"), ("iri", "_:g"), ("triple", None), ("iri", None)]
    assert (rows[3]["qs"], rows[3]["qp"], rows[3]["qo"]) == ("s", "p", "_:o")
    assert (rows[2]["o_lang"], rows[4]["o_datatype"], rows[4]["s"]) == ("en-GB", "d", "s t")
    again = Q.parse_nquads(Q.to_nquads(Q.parse_nquads(given)).withColumn("ord", F.lit(0).cast("long")))
    columns = [c for c in again.columns if c != "ord"]
    assert sorted(map(str, again.select(columns).collect())) == sorted(str(r) for r in Q.parse_nquads(given).select(columns).collect())


def test_bad_lines_are_told(spark):
    given = lines(spark, "<s> <p> <o> .", "<s> <p> no .", '<s> <p> "a\\qb" .')
    assert [r["value"] for r in Q.bad_nquads(given).collect()] == ["<s> <p> no ."]
    with pytest.raises(Exception, match="not a quad"):
        Q.parse_nquads(given.limit(2)).collect()
    with pytest.raises(Exception, match="bad escape"):
        Q.parse_nquads(given, on_error="drop").select("o").collect()
    assert Q.parse_nquads(given.limit(2), on_error="drop").count() == 1


def test_jsonld_escapes(spark):
    import json

    df = spark.createDataFrame([('urn:a"b', 'x"y\\z\n')], "s string, label string")
    r = Registry([{"$id": "urn:l", "type": "object", "properties": {"label": {"type": "string"}}}])
    node = json.loads(Q.to_jsonld(Q.Emitter(r).quads(df, "urn:l", F.col("s"), row_value(df.select("label")))).first()["node"])
    assert node["@id"] == 'urn:a"b'
    assert node["urn:l#label"][0]["@value"] == 'x"y\\z\n'


def test_invalid_documents_are_errors_and_contents_name_subjects(spark):
    r = Registry([{"$id": "urn:d", "type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}}, "anyOf": [{"properties": {"extra": {"type": "string"}}}]}])
    df = spark.createDataFrame([('{"n": 1, "extra": "x"}',), ('{"n": "no"}',)], "j string").select(F.parse_json("j").alias("d"))
    with pytest.raises(Exception, match="type"):
        Q.document_quads(df, Q.Emitter(r), Compiler(r), "urn:d", "d").collect()
    q = Q.document_quads(df, Q.Emitter(r), Compiler(r), "urn:d", "d", on_invalid="drop").collect()
    assert {(x["p"], x["o"]) for x in q if x["p"] != Q.TYPE} == {("urn:d#n", "1"), ("urn:d#extra", "x")}
    assert len({x["s"] for x in q}) == 1
    raw = Q.Emitter(r).quads(df, "urn:d", F.lit("urn:x"), Variant(F.col("d"))).where(F.col("p") == "urn:d#n")
    assert [x["o"] for x in raw.collect()] == ["1"]


@pytest.mark.parametrize(("pattern", "fits"), [("(?<n>a)\\k<n>", True), ("(?P<n>a)", False), ("a{", False), ("a{2,3}?", True), ("[", False), ("\\a", False), ("a++", False), ("[^]", True), ("\\p{L}+", True), ("(?i)a", False), ("a\\++", True), ("[[]", True)])
def test_patterns_are_those_of_ecmascript(pattern, fits):
    assert is_regex(pattern) == fits


EVENT = Registry([{"$id": "urn:e", "type": "object", "properties": {"v": {"maximum": 9}}}])


def test_rows_later_than_the_watermark_are_left_out(spark, tmp_path):
    import os

    source = tmp_path / "in"
    for i, rows in enumerate(([("2024-01-01 10:05:00", 1), ("2024-01-01 13:00:00", 99)], [("2024-01-01 13:05:00", 1)], [("2024-01-01 10:30:00", 1), ("2024-01-01 12:55:00", 1)], [("2024-01-01 16:00:00", 1)], [("2024-01-01 16:01:00", 1)])):
        df = spark.createDataFrame(rows, "ts string, v int").select(F.to_timestamp("ts").alias("ts"), "v").coalesce(1)
        df.write.mode("append").parquet(str(source))
        for f in source.glob("*.parquet"):  # in order of their times
            if f.stat().st_mtime > 1_700_000_100 + i:
                os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = S.validated(S.read_stream(spark, str(source), "ts timestamp, v int", files_per_trigger=1), Compiler(EVENT), "urn:e")
    out = S.run_once(S.error_rates(stream, "ts", "1 hour", "10 minutes"), "late_rows", "append")
    got = {r["window_start"].hour: (r["n_rows"], r["n_invalid"]) for r in out.collect()}
    assert got[10] == (1, 0)  # the row of 10:30 came when the watermark was at 12:50
    assert got[12] == (1, 0)
    assert got[13] == (2, 1)


def test_streams_are_split(spark, tmp_path):
    spark.createDataFrame([(1, 5), (2, 50)], "k int, v int").write.parquet(str(tmp_path / "in"))
    stream = S.read_stream(spark, str(tmp_path / "in"), "k int, v int")
    S.split(stream, Compiler(EVENT), "urn:e", str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "state")).awaitTermination()
    assert [r["k"] for r in spark.read.parquet(str(tmp_path / "good")).collect()] == [1]
    assert [r["k"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [2]


def test_terms_of_other_libraries(spark):
    term = "struct<termType:string,value:string,subject:struct<termType:string,value:string>,predicate:struct<termType:string,value:string>,object:struct<termType:string,value:string>>"
    schema = f"subject {term}, predicate struct<termType:string,value:string>, object struct<termType:string,value:string,datatype:struct<termType:string,value:string>,language:string>, graph struct<termType:string,value:string>"
    named, blank = lambda x: ("NamedNode", x), lambda x: ("BlankNode", x)
    subject = lambda t: (*t, None, None, None)
    rows = [
        (subject(named("urn:s")), named("urn:p"), ("Literal", "x", None, "en"), ("DefaultGraph", "")),
        (subject(blank("b")), named("urn:p"), ("Literal", "1", named(Q.XSD + "integer"), ""), named("urn:g")),
        (("Quad", "", named("urn:s"), named("urn:p"), blank("o")), named("urn:q"), ("BlankNode", "_:c", None, None), None),
        (subject(named("urn:s")), named("urn:p"), ("Literal", "plain", None, None), blank("g")),
    ]
    q = Q.from_terms(spark.createDataFrame(rows, schema))
    got = sorted(tuple(r)[:11] for r in q.collect())
    none = (None,) * 3
    assert got == sorted([
        ("urn:s", "iri", "urn:p", "x", "literal", Q.RDF + "langString", "en", None, *none),
        ("_:b", "bnode", "urn:p", "1", "literal", Q.XSD + "integer", None, "urn:g", *none),
        ("<<urn:s urn:p _:o>>", "triple", "urn:q", "_:c", "bnode", None, None, None, "urn:s", "urn:p", "_:o"),
        ("urn:s", "iri", "urn:p", "plain", "literal", Q.XSD + "string", None, "_:g", *none),
    ], key=lambda r: r[:4])
    assert sorted(tuple(r)[:11] for r in Q.from_terms(Q.to_terms(q)).collect()) == got
    for bad in ((subject(("Variable", "v")), named("urn:p"), ("Literal", "x", None, None), None), (subject(named("urn:s")), blank("p"), ("Literal", "x", None, None), None), (subject(named("urn:s")), named("urn:p"), None, None)):
        with pytest.raises(Exception, match="not a quad of terms"):
            Q.from_terms(spark.createDataFrame([bad], schema)).collect()


def test_equal_items_of_a_list_come_back(spark):
    """With ``repeats`` each place counts, and a quad said twice at one place is one; without, quads are a set."""
    bag = {"$id": "urn:x:bag", "type": "object", "properties": {"n": {"type": "array", "items": {"type": "integer"}}}}
    df = spark.createDataFrame([(1, [5, 7, 5, 5])], "k int, n array<int>")
    r = Registry([bag])
    q = Q.Emitter(r).quads(df, bag["$id"], F.lit("urn:x:1"), row_value(df.select("n")))
    twice = q.unionByName(q)
    assert Q.lift(twice, r, bag["$id"], repeats=True).first()["instance"]["n"] == [5, 7, 5, 5]
    assert Q.lift(twice, r, bag["$id"]).first()["instance"]["n"] == [5, 7]


@pytest.mark.parametrize("name", ["q_lift_ordered", "q_lift_structural_nested"])
def test_baskets_with_equal_prices(spark, tmp_path, name):
    """Two orders of one customer at the same price are two items."""
    db = duckdb.connect()
    db.sql(f"COPY (SELECT * REPLACE (o_totalprice - o_totalprice % 50000 AS o_totalprice) FROM '/root/testdata/sf0.001/orders.parquet') TO '{tmp_path}/orders.parquet'")
    db.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    got, want = graphs.QUERIES[name](spark, str(tmp_path)), db.sql(graphs.SQL[name])
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())


def test_customers_are_dealt(spark, tmp_path):
    """A table of one row group: no task makes the quads of all rows, nor sorts them by their subject."""
    spark.range(0, 400, 1, 1).selectExpr("id AS c_custkey", "'c' || id AS c_name", "1 AS c_nationkey", "id / 4 AS c_acctbal", "'BUILDING' AS c_mktsegment").write.parquet(str(tmp_path / "customer.parquet"))
    made = graphs.customers(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(made) == spark.sparkContext.defaultParallelism and {r["count"] for r in made} == {500}


def _links(spark, lists):
    rows = [(s, Q.RDF + p, o) for cells in lists for s, item, rest in cells for p, o in (("first", item), ("rest", rest))]
    return spark.createDataFrame(rows, "s string, p string, o string")


def test_odd_lists(spark):
    """Lists that share a tail, a quad said twice, a cycle, a list of nine, and nil as a cell."""
    nil = Q.RDF + "nil"
    nine = [(f"_:n{i}", str(i), f"_:n{i + 1}" if i < 8 else nil) for i in range(9)]
    fork = [("_:a", "x", "_:t"), ("_:b", "y", "_:t"), ("_:t", "z", nil)]
    cycle = [("_:c", "1", "_:d"), ("_:d", "2", "_:c")]
    q = _links(spark, [nine, fork, cycle])
    q = q.unionByName(q.where("p LIKE '%rest'"))
    want = sorted([*(("_:n0", i, str(i)) for i in range(9)), ("_:a", 0, "x"), ("_:a", 1, "z"), ("_:b", 0, "y"), ("_:b", 1, "z")])
    assert sorted(tuple(r) for r in Q.lists(q).collect()) == want
    odd = _links(spark, [[("_:a", "x", nil), (nil, "y", "_:e"), ("_:e", "z", "_:end")]])
    assert sorted(tuple(r) for r in Q.lists(odd).collect()) == [("_:a", 0, "x"), ("_:a", 1, "y"), ("_:a", 2, "z")]
    assert Q.lists(q.limit(0)).count() == 0


def test_rounds_of_lists_shrink(spark, monkeypatch):
    """Cells that have found their head take no part in later rounds."""
    kept, store = [], selection.stored
    monkeypatch.setattr(selection, "stored", lambda df: kept.append(store(df)) or kept[-1])
    q = _links(spark, [[(f"_:{k}/{i}", str(i), f"_:{k}/{i + 1}" if i < k else Q.RDF + "nil") for i in range(k + 1)] for k in range(8)])
    assert Q.lists(q).count() == 36
    assert [x.count() for x in kept[2:]] == [28, 21, 10]


def test_lift_reads_what_it_needs_of_a_source(spark):
    """Each class asks for its own predicates, and the links between them are asked for alone."""
    sf, asked = "/root/testdata/sf0.001", []
    r, q = graphs.Registry(graphs.REGISTRY), graphs.nested_orders(spark, sf)
    source = lambda only: asked.append(only) or graphs.nested_orders(spark, sf, *only)
    rows = lambda df: sorted(repr(x) for x in df.collect())
    assert rows(Q.lift(q, r, graphs.ORDER["$id"], source=source)) == rows(Q.lift(q, r, graphs.ORDER["$id"]))
    assert {graphs.P["lines"]} in asked and {Q.TYPE, graphs.P["l_partkey"], graphs.P["l_quantity"]} in asked
