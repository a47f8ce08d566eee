"""JSON-LD to quads and back."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from schemaloom.catalogue import graphs
from schemaloom.operators import jsonld as J
from schemaloom.operators.quads import RDF, SCHEMA, XSD, parse_nquads
from schemaloom.operators.selection import shared_dir
from schemaloom.sources.tables import dealt

E = "https://e/"
DOC = {
    "@context": {"ex": E, "knows": {"@id": "ex:knows", "@type": "@id"}, "when": {"@id": "ex:when", "@type": XSD + "date"}, "@vocab": E + "v#"},
    "@graph": [
        {
            "@id": "ex:a", "@type": ["ex:T", "U"], "knows": ["ex:b", "http://x/y"], "when": "2024-01-01", "ex:n": [1, 2.5, True, None, "text", "ex:c", "un:known", [5]],
            "ex:l": {"@list": [1, "b", {"ex:deep": {"@list": [{"@id": "ex:z", "ex:q": 5}]}}, {"@list": []}]}, "ex:in": {"ex:v": {"@value": "x", "@language": "en"}, "ex:w": {"ex:k": 1}},
            "ex:set": {"@set": [1, {"@id": "_:mine"}]}, "ex:empty": {},
        },
        {"plain": 1}, "not a node",
    ],
}


def slow_read(doc, key):
    """The same by recursion, with blank nodes named by their place."""
    context, out = doc.get("@context", {}), set()
    names = {k: v if isinstance(v, str) else v.get("@id") for k, v in context.items()}
    types = {k: v["@type"] for k, v in context.items() if isinstance(v, dict) and "@type" in v}

    def expand(x):
        x = names.get(x) or (names["@vocab"] + x if ":" not in x and "@vocab" in names else x)
        head, colon, tail = x.partition(":")
        return names[head] + tail if colon and head in names and not tail.startswith("//") else x

    def literal(v, datatype=None, lang=None):
        own = "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "double" if isinstance(v, float) else "string"
        return v if isinstance(v, str) else json.dumps(v), "literal", RDF + "langString" if lang else datatype or XSD + own, lang

    def term(v, at, wanted):
        if v is None or isinstance(v, list):
            return None
        if isinstance(v, dict):
            if "@list" in v:
                head = f"_:{key}_{at}" + "-0" if v["@list"] else RDF + "nil"
                for i, x in enumerate(v["@list"]):
                    cell = f"_:{key}_{at}-{i}"
                    if t := term(x, f"{at}.{i}.0", None):
                        out.add((cell, RDF + "first", *t))
                    following = f"_:{key}_{at}-{i + 1}" if i + 1 < len(v["@list"]) else RDF + "nil"
                    out.add((cell, RDF + "rest", following, "bnode" if following[0] == "_" else "iri", None, None))
                return head, "bnode" if v["@list"] else "iri", None, None
            if "@value" in v:
                return literal(v["@value"], expand(v["@type"]) if "@type" in v else None, v.get("@language"))
            s = expand(v["@id"]) if "@id" in v else f"_:{key}_{at}"
            node(v, s, at)
            return s, "bnode" if s.startswith("_:") else "iri", None, None
        if isinstance(v, str) and (wanted == "@id" or wanted is None and (v.startswith(("_:", "http://", "https://", "urn:")) or ":" in v and v.split(":")[0] in names)):
            return expand(v), "bnode" if v.startswith("_:") else "iri", None, None
        return literal(v, wanted)

    def node(n, s, at):
        for i, k in enumerate(sorted(k for k in n if k not in ("@id", "@context", "@graph"))):
            v = n[k]["@set"] if isinstance(n[k], dict) and "@set" in n[k] else n[k]
            for j, x in enumerate(v if isinstance(v, list) else [v]):
                if t := term(x, f"{at}.{i}.{j}", "@id" if k == "@type" else types.get(k)):
                    out.add((s, RDF + "type" if k == "@type" else expand(k), *t))

    for i, n in enumerate(doc["@graph"] if "@graph" in doc else [doc]):
        if isinstance(n, dict):
            node(n, expand(n["@id"]) if "@id" in n else f"_:{key}_{i}", str(i))
    return out


def read(spark, docs):
    df = spark.createDataFrame([(f"k{i}", json.dumps(d)) for i, d in enumerate(docs)], "k string, t string").select("k", F.parse_json("t").alias("d"))
    return J.from_jsonld(df, "d", F.col("k"))


def plain(q):
    return {tuple(r) for r in q.select("s", "p", "o", "o_kind", "o_datatype", "o_lang").collect()}


def test_reader_against_recursion(spark):
    deep = {"@id": "urn:d"}
    for i in range(60):
        deep = {"@id": f"urn:d{i}", "urn:p": deep if i % 2 else {"@list": [deep, i]}}
    docs = [DOC, {"@id": "urn:one", "urn:p": [{"urn:q": 1}, {"urn:q": 2}]}, {}, deep]
    q = read(spark, docs)
    assert plain(q) == set().union(*(slow_read(d, f"k{i}") for i, d in enumerate(docs)))
    assert {(r["s_kind"], r["s"].startswith("_:")) for r in q.collect()} == {("iri", False), ("bnode", True)}
    with pytest.raises(Exception, match="nested deeper than 5"):
        J.from_jsonld(spark.createDataFrame([(json.dumps(deep),)], "t string").select(F.parse_json("t").alias("d")), "d", F.lit("k"), depth=5).collect()
    assert J.from_jsonld(spark.createDataFrame([(None,)], "t string").select(F.parse_json("t").alias("d")), "d", F.lit("k")).count() == 0


def shape(q):
    """The quads with each blank node under the name of the way that leads to it from a named subject."""
    rows = [tuple(r) for r in q.select("s", "p", "o", "o_kind", "o_datatype", "o_lang").collect()]
    name = {}
    while True:
        new = {o: f"{name.get(s, s)}>{p}>{sum(x[:2] == (s, p) and x[2] < o for x in rows)}" for s, p, o, k, _, _ in rows if k == "bnode" and o not in name and (not s.startswith("_:") or s in name)}
        if not new:
            return sorted(((name.get(s, s), p, name.get(o, o), *rest) for s, p, o, *rest in rows), key=str)
        name |= new


def test_writer_then_reader(spark):
    q = read(spark, [DOC])
    for native in (False, True):
        docs = J.to_jsonld_documents(q, native=native)
        nodes = {r["s"]: json.loads(r["node"]) for r in docs.collect()}
        assert len(nodes) == 3 and nodes[E + "a"][E + "in"][0][E + "w"] == [{E + "k": [1 if native else {"@value": "1", "@type": XSD + "integer"}]}]
        assert len(nodes[E + "a"][E + "l"][0]["@list"]) == 4 and nodes[E + "a"][E + "l"][0]["@list"][3] == {"@list": []}
        again = J.from_jsonld(docs.select(F.parse_json("node").alias("d"), F.md5("s").alias("k")), "d", F.col("k"))
        assert [r for r in shape(again) if "_:" not in str(r)] == [r for r in shape(q) if "_:" not in str(r)]


def test_writer_leaves_what_cannot_be_nested(spark):
    text = """_:a <urn:p> _:b .
_:b <urn:p> _:a .
<urn:x> <urn:q> _:shared .
<urn:y> <urn:q> _:shared .
_:shared <urn:v> "1" .
<urn:x> <urn:l> _:bad .
_:bad <{rdf}first> "1" .
<urn:y> <urn:l> _:c0 .
_:c0 <{rdf}first> "1" .
_:c0 <{rdf}rest> _:c1 .
_:c1 <{rdf}first> _:in .
_:c1 <{rdf}rest> <{rdf}nil> .
_:in <urn:v> "2" .""".replace("{rdf}", RDF)
    q = parse_nquads(spark.createDataFrame([(t, [i]) for i, t in enumerate(text.split("\n"))], "value string, ord array<long>"))
    nodes = {r["s"]: json.loads(r["node"]) for r in J.to_jsonld_documents(q, native=True).collect()}
    assert set(nodes) == {"_:a", "_:b", "_:shared", "urn:x", "urn:y"}
    assert nodes["_:a"]["urn:p"] == [{"@id": "_:b"}] and nodes["urn:x"]["urn:q"] == [{"@id": "_:shared"}]
    assert nodes["urn:x"]["urn:l"] == [{RDF + "first": ["1"]}]
    assert nodes["urn:y"]["urn:l"] == [{"@list": ["1", {"urn:v": ["2"]}]}]
    assert J.to_jsonld_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"@id": "ex:a", "ex:p": {"ex:q": 1}}\n\n{"@id": "ex:b", "ex:p": {"ex:q": 2}}\n')
    (tmp_path / "b.jsonl").write_text('{"@id": "ex:a", "ex:p": {"ex:q": 1}}\n')
    q = J.read_jsonld(spark, str(tmp_path), {"ex": E}, lines=True)
    assert q.count() == 6 and q.where("o_kind = 'bnode'").select("o").distinct().count() == 3
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "c.json").write_text(json.dumps(DOC, indent=1))
    assert J.read_jsonld(spark, str(tmp_path / "one")).count() == len(slow_read(DOC, "k"))


def test_few_small_rows_are_dealt_out(spark):
    """Rows that a shuffle brought together in one partition, as it does with small ones, are dealt to several tasks again."""
    df = spark.range(100).coalesce(1)
    assert dealt(df).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1 and dealt(df).count() == 100


@pytest.mark.parametrize("name", ["q_nquads_escapes"])
def test_lines_are_made_by_several_tasks(spark, sf, name):
    assert graphs.QUERIES[name](spark, sf).rdd.getNumPartitions() > 1


SHARED = """<urn:x> <urn:l> _:c0 .
<urn:x> <urn:in> _:n0 .
_:n0 <urn:in> _:n1 .
_:n0 <urn:also> "0" .
_:n1 <urn:l> _:c0 .
_:n1 <urn:in> _:n2 .
_:n2 <urn:v> "2" .
_:c0 <{rdf}first> _:i .
_:c0 <{rdf}rest> <{rdf}nil> .
_:i <urn:v> "1" .
_:i <urn:v> "3" .
_:r0 <urn:in> _:r1 .
_:r1 <urn:in> _:r0 .
_:r1 <urn:q> _:leaf .
_:leaf <urn:v> "4" .
_:t <urn:q> _:under .
_:t <urn:v> "5" .
_:under <urn:v> "6" .""".replace("{rdf}", RDF)


def test_writer_moves_each_text_to_all_that_wait_for_it(spark):
    """A list of two owners that are made in different rounds, nodes below a circle, and a blank node that nothing refers to."""
    q = parse_nquads(spark.createDataFrame([(t, [i]) for i, t in enumerate(SHARED.split("\n"))], "value string, ord array<long>"))
    shared = [{"@list": [{"urn:v": ["1", "3"]}]}]
    assert {r["s"]: json.loads(r["node"]) for r in J.to_jsonld_documents(q, native=True).collect()} == {
        "urn:x": {"@id": "urn:x", "urn:l": shared, "urn:in": [{"urn:in": [{"urn:l": shared, "urn:in": [{"urn:v": ["2"]}]}], "urn:also": ["0"]}]},
        "_:r0": {"@id": "_:r0", "urn:in": [{"@id": "_:r1"}]},
        "_:r1": {"@id": "_:r1", "urn:in": [{"@id": "_:r0"}], "urn:q": [{"urn:v": ["4"]}]},
        "_:t": {"@id": "_:t", "urn:q": [{"urn:v": ["6"]}], "urn:v": ["5"]},
    }


def test_writer_keeps_little_on_disk(spark):
    """The quads are kept once, by column and compressed; no round writes again what is made already."""
    folder = Path(shared_dir(spark).removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    item = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.concat(F.lit('{"urn:number":['), (F.col("id") * 10 + i).cast("string"), F.lit("]}"))), ",")
    docs = spark.range(4000).select(F.col("id").cast("string").alias("k"), F.parse_json(F.concat(F.lit('{"@id":"urn:d'), F.col("id").cast("string"), F.lit('","urn:items":[{"@list":['), item, F.lit("]}]}"))).alias("d"))
    q = J.from_jsonld(docs, "d", F.col("k"))
    before = size()
    assert J.to_jsonld_documents(q, native=True).count() == 4000
    assert size() - before < 60 * 4000 * 16


def test_reader_looks_members_up(spark):
    """A path that leads nowhere in a variant costs an exception, so the reader takes none for members that may be absent."""
    q = J.from_jsonld(spark.createDataFrame([("{}",)], "t string").select(F.parse_json("t").alias("d")), "d", F.lit("k"))
    assert "$[" not in q._jdf.queryExecution().optimizedPlan().toString()
