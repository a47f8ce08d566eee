"""The selection algebra: lazy bags of IRIs over a quads table.

A selection is a DataFrame (ord, iri). Steps are joins, terminals are actions. The order of a bag is carried in ``ord``:
a number, or an array of numbers once bags have been put after one another (the bag's own place first).
"""

from __future__ import annotations

import itertools
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.compiler import _At
from ..plans.registry import Registry
from .quads import RDFS, TYPE, Emitter


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share, ``spark.checkpoint.dir``; only a session within one process may go without."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def pinned(df: DataFrame) -> DataFrame:
    """Lineage cut by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Lineage cut by a Parquet table in the shared folder: smaller than a checkpoint, and read by column, for many rows that are
    read more than once. It goes with the session."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


class CardinalityError(ValueError):
    """one() found none or several."""

    code = "CURSOR_CARDINALITY"


class Graph:
    """Quads of instances with what is known of their schema.

    ``identity``: predicate -> range of inverse-functional properties; ``ranges``: predicate -> ranges that a literal of it
    may refer to; ``domains``: predicate -> classes. They are schema-sized; the quads are not.
    """

    def __init__(self, quads: DataFrame, identity: dict[str, str] | None = None, ranges: dict[str, list[str]] | None = None, domains: dict[str, list[str]] | None = None, resolver: Callable[[str], str] = lambda name: name, schema: DataFrame | None = None, source: Callable[[set[str]], DataFrame] | None = None):
        """``source`` gives the quads of some predicates where that is cheaper than to filter all: an emitter told what is wanted, or folders by predicate."""
        self.quads, self.identity, self.ranges, self.domains, self.resolver, self.schema, self.source = quads, identity or {}, ranges or {}, domains or {}, resolver, schema, source
        self._known: dict[frozenset, DataFrame] = {}

    def of_predicates(self, *predicates: str) -> DataFrame:
        wanted = frozenset(predicates)
        if wanted not in self._known:
            found = self.quads if self.source is None else self.source(set(wanted))
            self._known[wanted] = found.where(F.col("p").isin(*sorted(wanted)))
        return self._known[wanted]

    @property
    def _types(self) -> DataFrame:
        return self.of_predicates(TYPE)

    @classmethod
    def of(cls, registry: Registry, quads: DataFrame, emitter: Emitter | None = None, schema: DataFrame | None = None, source: Callable[[set[str]], DataFrame] | None = None) -> Graph:
        """A graph whose identity, ranges and domains come from the registry's schemas.

        A property that is inverse functional identifies its class's instances: its range is the schema that it refers to,
        or its own predicate. Superclasses' properties are their subclasses' too, so identity is inherited: a reference to a
        class's key also finds instances of its subclasses. Names without a scheme are properties of any class, if but one
        class declares them.
        """
        emitter = emitter or Emitter(registry)
        identity: dict[str, str] = {}
        ranges: dict[str, list[str]] = {}
        domains: dict[str, list[str]] = {}
        named: dict[str, set[str]] = {}
        for key in registry:
            for name, (sub, own) in emitter.shapes.properties(registry[key], _At(key)).items():
                p = emitter.predicate(own.root, name, sub)
                named.setdefault(name, set()).add(p)
                domains.setdefault(p, [])
                if key not in domains[p]:
                    domains[p].append(key)
                said = sub if isinstance(sub, dict) else {}
                target = said.get("items", said) if isinstance(said.get("items", said), dict) else {}
                ref = registry.expand(target["$ref"]) if "$ref" in target and not target["$ref"].startswith("#") else None
                if ref and ref not in ranges.setdefault(p, []):
                    ranges[p].append(ref)
                if said.get("inverseFunctional"):
                    identity[p] = ref or p
        sub_classes: dict[str, set[str]] = {}
        for key in registry:
            for parent in registry.parents(key):
                sub_classes.setdefault(parent, set()).add(key)
        # a range that names a class is met by the keys that identify its instances, and its subclasses' with them
        for p, wanted in ranges.items():
            for r in list(wanted):
                todo, seen = [r], {r}
                while todo:
                    c = todo.pop()
                    todo += [x for x in sub_classes.get(c, ()) if x not in seen]
                    seen |= sub_classes.get(c, set())
                    wanted += [identity[k] for k, d in domains.items() if c in d and k in identity and identity[k] not in wanted]

        def resolve(name: str) -> str:
            found = named.get(name, set())
            if len(found) != 1:
                raise KeyError(f"{name} is a property of {len(found)} predicates")
            return next(iter(found))

        return cls(quads, identity, ranges, domains, resolve, schema, source)

    def predicate(self, token: str) -> str:
        return token if "://" in token or token.startswith(("urn:", "_:")) else self.resolver(token)

    def domain(self, name: str) -> SchemaSelection:
        return SchemaSelection(self, list(self.domains.get(self.predicate(name), [])))

    def range(self, name: str) -> SchemaSelection:
        return SchemaSelection(self, list(self.ranges.get(self.predicate(name), [])))

    def class_(self, iri: str) -> SchemaSelection:
        return SchemaSelection(self, [iri])

    def resource(self, iri: str) -> Selection:
        return Selection(self, self.quads.sparkSession.createDataFrame([(0, iri)], "ord bigint, iri string"))

    def instances(self, class_iri: str) -> Selection:
        """Subjects of that very type, in order, each as often as it is said."""
        return Selection(self, self._types.where((F.col("o") == class_iri) & (F.col("o_kind") != "literal")).select("ord", F.col("s").alias("iri")))

    def foreign_range(self, p: str) -> str | None:
        """The identity range that literals of a predicate resolve in."""
        if p in self.identity:
            return self.identity[p]
        return next((r for r in self.ranges.get(p, []) if r in self.identity.values()), None)

    def entities(self, wanted: str) -> DataFrame:
        """value, entity: the instances that inverse-functional properties of a range identify; of several the last wins."""
        mine = [p for p, r in self.identity.items() if r == wanted]
        found = self.of_predicates(*mine).where(F.col("o_kind") == "literal")
        return found.groupBy(F.col("o").alias("value")).agg(F.max_by("s", F.struct("ord", "s")).alias("entity"))

    def edges(self, p: str) -> DataFrame:
        """s, o, ord of a predicate, literals resolved to the entities that they identify; unresolved ones stay."""
        out = self.of_predicates(p).select("s", "o", "o_kind", "ord")
        wanted = self.foreign_range(p)
        if wanted is None:
            return out.select("s", "o", "ord")
        e = self.entities(wanted)
        literal = F.col("o_kind") == "literal"
        return out.join(e, literal & (F.col("o") == F.col("value")), "left").select("s", F.coalesce("entity", "o").alias("o"), "ord")

    def inverse_edges(self, p: str) -> DataFrame:
        """s, o, ord for going backwards: direct links, and literal holders to the entity that they refer to, save itself."""
        direct = self.of_predicates(p).select("s", "o", "ord")
        wanted = self.foreign_range(p)
        if wanted is None:
            return direct
        held = self.of_predicates(p).where((F.col("o_kind") == "literal") & (F.col("s_kind") == "iri"))
        through = held.join(self.entities(wanted), F.col("o") == F.col("value")).where(F.col("s") != F.col("entity"))
        return direct.unionByName(through.select("s", F.col("entity").alias("o"), "ord"))


class Selection:
    """A bag of IRIs in order."""

    def __init__(self, graph: Graph, rows: DataFrame):
        self.graph, self.rows = graph, rows

    def _with(self, rows: DataFrame) -> Selection:
        return Selection(self.graph, rows.select("ord", "iri"))

    def _predicates(self, p: str | list[str]) -> list[str]:
        return [self.graph.predicate(x) for x in ([p] if isinstance(p, str) else p)]

    def objects(self, p: str | list[str]) -> Selection:
        """Distinct values over the predicates, in order of the first source."""
        return self._step(p, self.graph.edges, "s", "o")

    def subjects(self, p: str | list[str]) -> Selection:
        return self._step(p, self.graph.inverse_edges, "o", "s")

    def _step(self, p, edges, source, target) -> Selection:
        out = None
        for x in self._predicates(p):
            e = edges(x)
            hop = self.rows.join(e.withColumnRenamed("ord", "_edge"), F.col("iri") == F.col(source)).select(F.col("ord"), F.col(target).alias("_to"))
            out = hop if out is None else out.unionByName(hop)
        return self._with(out.groupBy(F.col("_to").alias("iri")).agg(F.min("ord").alias("ord")))

    def closure(self, p: str | list[str]) -> Selection:
        """All that is reachable over the predicates, the seeds included, however far. Each hop joins the frontier only; known IRIs are left out, so cycles end."""
        edges = None
        for x in self._predicates(p):
            e = self.graph.edges(x).select("s", "o")
            edges = e if edges is None else edges.unionByName(e)
        edges = pinned(edges.distinct())
        seen = pinned(self.distinct().rows.select("iri", F.lit(0).alias("hop")))
        for hop in itertools.count(1):
            frontier = seen.where(F.col("hop") == hop - 1)
            found = frontier.join(edges, F.col("iri") == F.col("s")).select(F.col("o").alias("iri")).distinct()
            found = pinned(found.join(seen, "iri", "left_anti"))
            if found.isEmpty():
                break
            seen = seen.unionByName(found.withColumn("hop", F.lit(hop)))
            if hop % 8 == 0:
                seen = pinned(seen)
        return self._with(seen.select(F.col("hop").cast("bigint").alias("ord"), "iri"))

    def subgraph(self, depth: int) -> Selection:
        """Neighbours within so many hops forward over links to resources, types aside; no literals are resolved."""
        links = self.graph.quads.where((F.col("o_kind") != "literal") & (F.col("p") != TYPE)).select("s", "o")
        seen = self.distinct().rows.select("iri", F.lit(0).cast("bigint").alias("ord"))
        frontier = seen
        for hop in range(1, depth + 1):
            found = frontier.join(links, F.col("iri") == F.col("s")).select(F.col("o").alias("iri")).distinct().join(seen.select("iri"), "iri", "left_anti")
            frontier = pinned(found.withColumn("ord", F.lit(hop).cast("bigint")))
            seen = seen.unionByName(frontier)
        return self._with(seen)

    def of_type(self, class_iri: str) -> Selection:
        """Those of that very type."""
        typed = self.graph._types.where(F.col("o") == class_iri).select(F.col("s").alias("iri"))
        return self._with(self.rows.join(typed, "iri", "left_semi"))

    def having(self, p: str, value) -> Selection:
        """Those with a value of a predicate that equals a constant: text, number or boolean as the datatype decodes."""
        from .quads import DECIMAL_TYPES, INTEGER_TYPES

        q = self.graph.of_predicates(self.graph.predicate(p))
        q = q if self.graph.schema is None else q.unionByName(self.graph.schema)
        name = F.substring_index("o_datatype", "#", -1)
        if isinstance(value, bool):
            fits = (name == "boolean") & (F.col("o").isin("true", "1") == F.lit(value))
        elif isinstance(value, (int, float)):
            fits = name.isin(*INTEGER_TYPES, *DECIMAL_TYPES) & (F.col("o").try_cast("double") == float(value))
        else:
            fits = (F.col("o") == value) & (F.col("o_datatype").isNull() | ~name.isin("boolean", *INTEGER_TYPES, *DECIMAL_TYPES))
        mine = q.where((F.col("p") == self.graph.predicate(p)) & fits).select(F.col("s").alias("iri"))
        return self._with(self.rows.join(mine, "iri", "left_semi"))

    def where(self, instances: DataFrame, condition: Column) -> Selection:
        """Those whose lifted instance (columns s, instance) satisfies a condition."""
        return self._with(self.rows.join(instances.where(condition).select(F.col("s").alias("iri")), "iri", "left_semi"))

    def order_by(self, instances: DataFrame, *keys: Column) -> Selection:
        """In order of keys of the lifted instances; equal ones stay as they are. The sort is by ranges, and a place is numbered by its range and its row there, so no task sees all."""
        joined = self.rows.join(instances.withColumnRenamed("s", "iri"), "iri")
        ranged = pinned(joined.orderBy(*keys, "ord", "iri").select("iri"))
        return self._with(ranged.withColumn("ord", F.monotonically_increasing_id()))

    def numbered(self) -> DataFrame:
        """iri and its place from 1 on. Ranges are sorted, and each starts where those before it end: only a count for each range is brought together."""
        from pyspark.sql import Window

        ranged = pinned(self.rows.orderBy("ord", "iri").select("iri").withColumn("at", F.monotonically_increasing_id()))
        ranged = ranged.select("iri", F.shiftright("at", 33).alias("range"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))
        sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("size"))
        starts = sizes.select("range", (F.sum("size").over(Window.orderBy("range")) - F.col("size")).alias("start"))
        return ranged.join(F.broadcast(starts), "range").select("iri", (F.col("start") + F.col("row") + 1).alias("place"))

    def limit(self, n: int) -> Selection:
        """The first n; a negative n leaves out so many from the end."""
        if n < 0:
            n = max(0, self.count() + n)
        return self._with(self.rows.orderBy("ord", "iri").limit(n))

    def top(self, instances: DataFrame, n: int, *keys: Column) -> Selection:
        """order_by and limit at once: each task keeps its best n, so nothing is sorted as a whole."""
        best = self.rows.join(instances.withColumnRenamed("s", "iri"), "iri").orderBy(*keys, "ord", "iri").limit(n)
        return self._with(best)

    def union(self, other: Selection) -> Selection:
        """A bag: the other's after these, whatever their own places are."""
        def placed(rows: DataFrame, side: int) -> DataFrame:
            own = F.col("ord") if rows.schema["ord"].dataType.typeName() == "array" else F.array("ord")
            return rows.withColumn("ord", F.concat(F.array(F.lit(side).cast("bigint")), own.cast("array<bigint>")))

        return self._with(placed(self.rows, 0).unionByName(placed(other.rows, 1)))

    def intersect(self, other: Selection) -> Selection:
        """Those that the other holds too; repeats and order stay."""
        return self._with(self.rows.join(other.rows.select("iri").distinct(), "iri", "left_semi"))

    def minus(self, other: Selection) -> Selection:
        """Extension: those that the other doesn't hold."""
        return self._with(self.rows.join(other.rows.select("iri").distinct(), "iri", "left_anti"))

    def distinct(self) -> Selection:
        return self._with(self.rows.groupBy("iri").agg(F.min("ord").alias("ord")))

    # terminals

    def count(self) -> int:
        return self.rows.count()

    def some(self) -> bool:
        return not self.rows.isEmpty()

    def none(self) -> bool:
        return self.rows.isEmpty()

    def first(self) -> str | None:
        row = self.rows.orderBy("ord", "iri").limit(1).collect()
        return row[0]["iri"] if row else None

    def one(self) -> str:
        row = self.rows.limit(2).collect()
        if len(row) != 1:
            raise CardinalityError(f"expected one, found {'none' if not row else 'several'}")
        return row[0]["iri"]

    def iris(self) -> DataFrame:
        return self.rows.select("iri")

    def all(self, instances: DataFrame) -> DataFrame:
        """iri and instance of each; what has none stays with a null instance."""
        return self.rows.join(instances.withColumnRenamed("s", "iri"), "iri", "left").select("ord", "iri", "instance")


class SchemaSelection:
    """Classes of the schema. They are schema-sized, so their algebra is a list on the driver."""

    def __init__(self, graph: Graph, classes: list[str]):
        self.graph, self.classes = graph, list(dict.fromkeys(classes))

    def _supers(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        if self.graph.schema is not None:
            for r in self.graph.schema.where(F.col("p") == RDFS + "subClassOf").select("s", "o").collect():
                out.setdefault(r["s"], []).append(r["o"])
        return out

    def sub_class_of(self, transitive: bool = False) -> SchemaSelection:
        """Superclasses, direct or all; a class is its own only in a cycle."""
        supers, found = self._supers(), []
        todo = [s for c in self.classes for s in supers.get(c, [])]
        while todo:
            c = todo.pop(0)
            if c not in found:
                found.append(c)
                if transitive:
                    todo += supers.get(c, [])
        return SchemaSelection(self.graph, found)

    def properties(self) -> list[str]:
        return sorted({p for p, d in self.graph.domains.items() if set(d) & set(self.classes)})

    def iris(self) -> list[str]:
        return self.classes

    def count(self) -> int:
        return len(self.classes)

    def one(self) -> str:
        if len(self.classes) != 1:
            raise CardinalityError(f"expected one, found {len(self.classes)}")
        return self.classes[0]
