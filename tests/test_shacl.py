"""Shapes as Boolean algebra over counts, against shapes as sets of failing nodes."""

import random

from pyspark.sql import functions as F

from schemaloom.operators.quads import SCHEMA, SH, TYPE, XSD
from schemaloom.operators.shacl import REPORT, Shape, Table, Validator, _cyclic

E = "urn:"


def made_shape(rng, name, depth):
    """A random node shape or property shape."""
    s = Shape(f"_:{name}")
    kids = lambda n: [made_shape(rng, f"{name}{rng.random()}", depth - 1) for _ in range(n)]
    if rng.random() < 0.7:
        s.path = E + rng.choice("pqr")
        for k, v in (("minCount", "1"), ("maxCount", "2"), ("pattern", "^[a-m1-5]"), ("minInclusive", "3"), ("datatype", XSD + "integer"), ("maxLength", "3"), ("nodeKind", SH + "IRI")):
            if rng.random() < 0.15:
                s.params[k] = v
        if rng.random() < 0.15:
            s.params["in"] = ["1", "2", E + "n1", "a"]
        if rng.random() < 0.1:
            s.params["hasValue"] = ["1"]
        if depth and rng.random() < 0.3:
            s.params |= {"qualifiedValueShape": kids(1)[0], "qualifiedMinCount": "1", "qualifiedMaxCount": "2"}
    else:
        if depth:
            s.properties = [k for k in kids(2) if k.path]
        if rng.random() < 0.2:
            s.params["closed"] = "true"
    if rng.random() < 0.1:
        s.params["class"] = [E + "A"]
    if rng.random() < 0.07:
        s.params["deactivated"] = "true"
    if depth:
        for k in ("node", "not"):
            if rng.random() < 0.25:
                s.params[k] = kids(1)
        for k in ("and", "or", "xone"):
            if rng.random() < 0.25:
                s.params[k] = [kids(2)]
    return s


def made_quads(spark, rng):
    rows = []
    names = [f"{E}n{i}" for i in range(14)]
    for n in names:
        for c in rng.sample("ABC", rng.randint(0, 2)):
            rows.append((n, TYPE, E + c, "iri", None))
        for _ in range(rng.randint(0, 5)):
            o, kind, datatype = rng.choice([(rng.choice(names), "iri", None), (str(rng.randint(0, 6)), "literal", XSD + "integer"), (rng.choice(["a", "zz", "long text"]), "literal", XSD + "string"), (f"{E}gone", "iri", None)])
            rows.append((n, E + rng.choice("pqr"), o, kind, datatype))
    rows = list(dict.fromkeys(rows))
    return spark.createDataFrame([(s, "iri", p, o, k, d, None, None, None, None, None, [i]) for i, (s, p, o, k, d) in enumerate(rows)], SCHEMA)


def plain(df):
    return sorted(map(str, df.select(*(f.split()[0] for f in REPORT.split(", "))).distinct().collect()))


def test_random_shapes(spark):
    rng = random.Random(7)
    n = 0
    for _ in range(2):
        q = made_quads(spark, rng).cache()
        shapes = {}
        for c in "ABC":
            s = made_shape(rng, c, 1)
            s.iri, s.path = E + c, None
            s.properties += [k for k in (made_shape(rng, f"{c}{i}", 1) for i in range(3)) if k.path]
            shapes[s.iri] = s
        v = Validator(shapes, q)
        assert not any(_cyclic(s, ()) for s in shapes.values())
        sets = None
        for s in shapes.values():
            for part in v.violations(s, v.types.where(F.col("class") == s.iri).select(F.col("node").alias("focus")), frozenset()):
                sets = part if sets is None else sets.unionByName(part)
        want = plain(sets) if sets is not None else []
        assert plain(Table(v).report(list(shapes.values()))) == want
        n += len(want)
    assert n > 10


def test_circles_of_shapes_end(spark):
    a, b = Shape(E + "A", properties=[]), Shape("_:p", path=E + "p")
    a.properties.append(b)
    b.params = {"node": [a], "minCount": "1"}
    rows = [(E + "x", TYPE, E + "A", "iri"), (E + "x", E + "p", E + "y", "iri"), (E + "y", TYPE, E + "A", "iri")]
    q = spark.createDataFrame([(s, "iri", p, o, k, None, None, None, None, None, None, [i]) for i, (s, p, o, k) in enumerate(rows)], SCHEMA)
    assert _cyclic(a, ())
    assert {(r["focus_node"], r["component"].split("#")[1]) for r in Validator({a.iri: a}, q).report().collect()} == {(E + "y", "MinCountConstraintComponent")}


def test_passes_over_the_quads_do_not_grow_with_shapes(spark):
    q = made_quads(spark, random.Random(1))
    inner = [Shape(f"_:{i}", properties=[Shape(f"_:p{i}", path=f"{E}{'pqr'[i % 3]}", params={"minInclusive": str(i)})]) for i in range(6)]
    s = Shape(E + "A", params={"or": [inner[:3]], "xone": [inner[3:]], "not": [inner[0]]})
    plan = Validator({s.iri: s}, q).report()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and plan.count("Exchange hashpartitioning") == 1
