"""SPARQL algebra to DataFrames.

A solution table has one string column per variable, terms in N-Triples form, null where unbound.
Variables known to be bound in every row are joined by plain equality, so Catalyst can hash or
sort-merge; only those that OPTIONAL, UNION or UNDEF may leave unbound need a null-tolerant condition.
Constants of a pattern are compared with the stored columns, where Parquet can use them.

Errors in expressions are null, and a filter takes null as false. Numbers are computed as doubles and
come back as integers where whole and decimals otherwise. A filter within EXISTS sees the variables of
its own pattern only. SERVICE and updates are not supported.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.functions import terms as t
from quadloom.operators.joins import product_join
from quadloom.operators.loops import closure
from quadloom.plans import sparql_parser as a

NUMERIC = {t.XSD + n for n in "integer decimal float double int long short byte nonNegativeInteger positiveInteger negativeInteger nonPositiveInteger unsignedInt unsignedLong unsignedShort unsignedByte".split()}


def c(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass
class Solutions:
    df: DataFrame
    bound: set[str]  # in every row

    @property
    def vars(self) -> list[str]:
        return self.df.columns


@dataclass
class Value:
    """An expression's value: a term, or its content where the type is known (num, int, bool, str)."""

    kind: str
    col: Column

    def number(self) -> Column:
        if self.kind in ("num", "int"):
            return self.col.cast("double")
        if self.kind == "term":
            dt = F.regexp_extract(self.col, r'^"[^"]*"\^\^<([^<>]*)>$', 1)
            return F.when(dt.isin(sorted(NUMERIC)), F.regexp_extract(self.col, r'^"([^"]*)"', 1).try_cast("double"))
        return F.lit(None).cast("double")

    def text(self) -> Column:
        """Of a string literal; other terms are an error."""
        if self.kind == "str":
            return self.col
        if self.kind == "term":
            return F.when(self.col.startswith('"'), t.lexical(self.col))
        return F.lit(None).cast("string")

    def string(self) -> Column:
        """STR()."""
        if self.kind == "term":
            return t.lexical(self.col)
        return t.lexical(self.term()) if self.kind != "str" else self.col

    def truth(self) -> Column:
        if self.kind == "bool":
            return self.col
        if self.kind in ("num", "int"):
            return (self.col != 0) & ~F.isnan(self.col.cast("double"))
        if self.kind == "str":
            return F.length(self.col) > 0
        n = self.number()
        dt = t.datatype(self.col)
        return F.when(dt == t.XSD + "boolean", t.lexical(self.col).isin("true", "1")).when(n.isNotNull(), (n != 0) & ~F.isnan(n)).when(dt.isin(t.XSD + "string", t.RDF + "langString"), F.length(t.lexical(self.col)) > 0)

    def term(self) -> Column:
        if self.kind == "term":
            return self.col
        if self.kind == "bool":
            return F.when(self.col.isNotNull(), F.concat(F.lit('"'), self.col.cast("string"), F.lit(f'"^^<{t.XSD}boolean>')))
        if self.kind == "str":
            return F.concat(F.lit('"'), t.escape(self.col), F.lit('"'))
        n = self.col.cast("double")
        whole = F.concat(F.lit('"'), n.try_cast("bigint").cast("string"), F.lit(f'"^^<{t.XSD}integer>'))
        part = F.concat(F.lit('"'), F.regexp_replace(n.try_cast("decimal(38,12)").cast("string"), r"0+$", ""), F.lit(f'"^^<{t.XSD}decimal>'))
        return whole if self.kind == "int" else F.when((n == F.floor(n)) & (F.abs(n) < 1e15), whole).otherwise(part)


def unbound() -> Value:
    return Value("term", F.lit(None).cast("string"))


def parts(nt: str) -> tuple[str, str, str | None, str | None]:
    """(kind, value, datatype, language) of a constant."""
    if nt.startswith("<"):
        return "iri", nt[1:-1], None, None
    if nt.startswith("_:"):
        return "bnode", nt[2:], None, None
    m = re.match(r'(?s)^"(.*)"(?:@([A-Za-z0-9-]+)|\^\^<([^<>]*)>)?$', nt)
    text = a._unescaped(m[1])
    return "lit", text, None if m[2] else m[3] or t.XSD + "string", m[2]


class Translator:
    """dataset: "default" sees the default graph outside GRAPH, "union" all graphs merged."""

    def __init__(self, quads: DataFrame, dataset: str = "default"):
        self.spark = quads.sparkSession
        self.quads, self.dataset = quads, dataset
        self.from_default: list[str] | None = None
        self.from_named: list[str] | None = None

    # Scans
    def active(self, graph) -> DataFrame:
        q = self.quads
        if graph is None:
            if self.from_default is not None:
                q = q.where(F.col("g").isin(self.from_default)) if self.from_default else q.where("false")
                return q if len(self.from_default) < 2 else q.dropDuplicates(["s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang"])
            return q.where("g is null") if self.dataset == "default" else q.dropDuplicates(["s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang"])
        q = q.where("g is not null")
        if self.from_named is not None:
            q = q.where(F.col("g").isin(self.from_named)) if self.from_named else q.where("false")
        return q if isinstance(graph, a.Var) else q.where(F.col("g") == parts(graph.nt)[1])

    def scan(self, s, p, o, graph) -> Solutions:
        q = self.active(graph)
        out: dict[str, Column] = {}
        same: list[Column] = []

        def bind(name: str, col: Column) -> None:
            if name in out:
                same.append(out[name] == col)
            else:
                out[name] = col

        if isinstance(s, a.Var):
            bind(s.name, t.subject_term())
        else:
            kind, value, _, _ = parts(s.nt)
            q = q.where((F.col("s") == value) & (F.col("s_kind") == kind))
        if isinstance(p, a.Var):
            bind(p.name, t.iri("p"))
        elif isinstance(p, a.Term):
            q = q.where(F.col("p") == parts(p.nt)[1])
        elif isinstance(p, a.PathNegated):
            q = q.where(~F.col("p").isin(p.forward))
        if isinstance(o, a.Var):
            bind(o.name, t.object_term())
        else:
            kind, value, dt, lang = parts(o.nt)
            q = q.where((F.col("o") == value) & (F.col("o_kind") == kind))
            if kind == "lit":
                q = q.where(F.col("o_lang") == lang) if lang else q.where(F.col("o_lang").isNull() & (F.coalesce("o_dt", F.lit(t.XSD + "string")) == dt))
        if isinstance(graph, a.Var):
            bind(graph.name, t.iri("g"))
        for x in same:
            q = q.where(x)
        return Solutions(q.select(*(col.alias(n) for n, col in out.items())) if out else q.select(F.lit(1).alias("_:one")), set(out))

    # Paths, as pairs (s, o) of terms, with the graph where it is a variable
    def path(self, p, graph) -> DataFrame:
        if isinstance(graph, a.Var) and not isinstance(p, (a.PathIri, a.PathNegated)):
            raise a.SparqlError("a path of more than one step needs a graph that is fixed")
        if isinstance(p, a.PathIri):
            return self.active(graph).where(F.col("p") == p.iri).select(t.subject_term().alias("s"), t.object_term().alias("o"))
        if isinstance(p, a.PathNegated):
            q, out = self.active(graph), None
            if p.forward or not p.backward:
                out = q.where(~F.col("p").isin(p.forward)).select(t.subject_term().alias("s"), t.object_term().alias("o"))
            if p.backward:
                back = q.where(~F.col("p").isin(p.backward)).select(t.object_term().alias("s"), t.subject_term().alias("o"))
                out = back if out is None else out.unionByName(back)
            return out
        if isinstance(p, a.PathInverse):
            return self.path(p.path, graph).select(F.col("o").alias("s"), F.col("s").alias("o"))
        if isinstance(p, a.PathSequence):
            out = self.path(p.parts[0], graph)
            for k, part in enumerate(p.parts[1:]):
                out = out.withColumnRenamed("o", "m").join(self.path(part, graph).withColumnRenamed("s", "m"), "m").select("s", "o")
            return out
        if isinstance(p, a.PathAlternative):
            return reduce(DataFrame.unionByName, (self.path(x, graph) for x in p.parts))
        raise a.SparqlError("not a path")

    def nodes(self, graph) -> DataFrame:
        q = self.active(graph)
        return q.select(t.subject_term().alias("n")).union(q.select(t.object_term().alias("n"))).distinct()

    def repeated(self, s, p: a.PathRepeat, o, graph) -> Solutions:
        edges = self.path(p.path, graph).distinct()
        if isinstance(s, a.Term):  # start from the end that is known
            pairs = self.reach(edges, s, p.many)
        elif isinstance(o, a.Term):
            pairs = self.reach(edges.select(F.col("o").alias("s"), F.col("s").alias("o")), o, p.many).select(F.col("o").alias("s"), F.col("s").alias("o"))
        else:
            pairs = closure(edges.select(F.col("s").alias("a"), F.col("o").alias("b"))).select(F.col("a").alias("s"), F.col("b").alias("o")) if p.many else edges
        if p.least == 0:
            zero = self.nodes(graph)
            for end in (s, o):
                if isinstance(end, a.Term):
                    zero = zero.where(F.col("n") == end.nt).union(self.spark.createDataFrame([(end.nt,)], "n string"))
            pairs = pairs.select("s", "o").unionByName(zero.select(F.col("n").alias("s"), F.col("n").alias("o"))).distinct()
        return self.ends(pairs, s, o)

    def reach(self, edges: DataFrame, start: a.Term, many: bool) -> DataFrame:
        if not many:
            return edges.where(F.col("s") == start.nt)
        one = self.spark.createDataFrame([(start.nt,)], "a string")
        return closure(edges.select(F.col("s").alias("a"), F.col("o").alias("b")), one).select(F.col("a").alias("s"), F.col("b").alias("o"))

    def ends(self, pairs: DataFrame, s, o) -> Solutions:
        out: dict[str, Column] = {}
        for end, col in ((s, F.col("s")), (o, F.col("o"))):
            if isinstance(end, a.Term):
                pairs = pairs.where(col == end.nt)
            elif end.name in out:
                pairs = pairs.where(out[end.name] == col)
            else:
                out[end.name] = col
        return Solutions(pairs.select(*(col.alias(n) for n, col in out.items())) if out else pairs.select(F.lit(1).alias("_:one")), set(out))

    def triple(self, x: a.Triple, graph) -> Solutions:
        if isinstance(x.p, (a.Term, a.Var)) or (isinstance(x.p, a.PathNegated) and not x.p.backward):
            return self.scan(x.s, x.p, x.o, graph)
        if isinstance(x.p, a.PathRepeat):
            return self.repeated(x.s, x.p, x.o, graph)
        if isinstance(x.p, a.PathSequence):  # as joined patterns, so that repeated parts work too
            ends, out = [x.s, *(a.Var(f"_:p{id(x)}.{k}") for k in range(1, len(x.p.parts))), x.o], None
            for k, part in enumerate(x.p.parts):
                part = a.Term(f"<{part.iri}>") if isinstance(part, a.PathIri) else part
                got = self.triple(a.Triple(ends[k], part, ends[k + 1]), graph)
                out = got if out is None else self.join(out, got)
            return out
        if isinstance(x.p, a.PathInverse):
            inner = a.Term(f"<{x.p.path.iri}>") if isinstance(x.p.path, a.PathIri) else x.p.path
            return self.triple(a.Triple(x.o, inner, x.s), graph)
        if isinstance(x.p, a.PathAlternative):
            got = [self.triple(a.Triple(x.s, a.Term(f"<{part.iri}>") if isinstance(part, a.PathIri) else part, x.o), graph) for part in x.p.parts]
            return reduce(self.union, got)
        return self.ends(self.path(x.p, graph), x.s, x.o)

    def bgp(self, triples: list[a.Triple], graph) -> Solutions:
        if not triples:
            return Solutions(self.spark.range(1).select(F.lit(1).alias("_:one")), set())
        left, out = list(triples), None
        names = lambda x: {e.name for e in (x.s, x.p, x.o) if isinstance(e, a.Var)}

        def cost(x: a.Triple) -> tuple:
            known = set(out.vars) if out is not None else set()
            free = names(x) - known
            apart = out is not None and not (names(x) & known)
            weight = [isinstance(x.s, a.Term), isinstance(x.o, a.Term), isinstance(x.p, a.Term)]
            return apart, -weight[0], -weight[1], len(free), -weight[2], isinstance(x.p, a.PathRepeat)

        subjects: set[str] = set()
        while left:  # most selective first, never across a product while something is connected
            x = min(left, key=cost)
            left.remove(x)
            got = self.triple(x, graph)
            shared = [v for v in got.vars if out is not None and v in out.vars]
            if shared and isinstance(x.s, a.Var) and x.s.name not in shared and not subjects & set(shared):
                # Objects meet objects: many nodes with many.
                out = Solutions(product_join(out.df, got.df, shared).select(*(c(v) for v in dict.fromkeys([*out.vars, *got.vars]))), out.bound | got.bound)
            else:
                out = got if out is None else self.join(out, got)
            if isinstance(x.s, a.Var):
                subjects.add(x.s.name)
        return out

    # Joins
    def matched(self, left: Solutions, right: Solutions) -> tuple[DataFrame, list[str], Column]:
        """(right with shared variables renamed, these, compatibility condition)."""
        shared = [v for v in left.vars if v in right.vars and v != "_:one"]
        r = right.df.drop("_:one") if "_:one" in left.vars and len(right.vars) > 1 else right.df
        for v in right.vars:
            if v in shared or (v == "_:one" and v in left.vars and v in r.columns):
                r = r.withColumnRenamed(v, v + "'")
        condition = F.lit(True)
        for v in shared:
            same = c(v) == c(v + "'")
            condition = condition & (same if v in left.bound and v in right.bound else same | c(v).isNull() | c(v + "'").isNull())
        return r, shared, condition

    def merged(self, df: DataFrame, left: Solutions, right: Solutions, shared: list[str]) -> DataFrame:
        cols = [F.coalesce(c(v), c(v + "'")).alias(v) if v in shared and not (v in left.bound) else c(v) for v in left.vars]
        return df.select(*cols, *(c(v) for v in right.vars if v not in left.vars))

    def join(self, left: Solutions, right: Solutions) -> Solutions:
        r, shared, condition = self.matched(left, right)
        loose = [v for v in shared if v not in left.bound or v not in right.bound]
        if not shared:
            df = left.df.crossJoin(r)
        elif not loose:
            df = left.df.join(r, condition, "inner")
        else:  # rows that have all the shared variables meet by equality; only the others need the condition that lets nulls pass
            has = lambda tail: reduce(Column.__and__, (c(v + tail).isNotNull() for v in loose))
            equal = reduce(Column.__and__, (c(v) == c(v + "'") for v in shared))
            whole = left.df.where(has("")).join(r.where(has("'")), equal, "inner")
            df = whole.unionByName(left.df.where(has("")).join(r.where(~has("'")), condition, "inner")).unionByName(left.df.where(~has("")).join(r, condition, "inner"))
        return Solutions(self.merged(df, left, right, shared), left.bound | right.bound)

    def left_join(self, left: Solutions, right: Solutions, expression) -> Solutions:
        r, shared, condition = self.matched(left, right)
        if expression is not None:
            env = {v: c(v) for v in left.vars} | {v: F.coalesce(c(v), c(v + "'")) if v in shared else c(v) for v in right.vars if v != "_:one"}
            condition = condition & F.coalesce(self.expr(expression, env).truth(), F.lit(False))
        return Solutions(self.merged(left.df.join(r, condition, "left"), left, right, shared), set(left.bound))

    def minus(self, left: Solutions, right: Solutions) -> Solutions:
        r, shared, condition = self.matched(left, right)
        if not shared:
            return left
        if not any(v in left.bound and v in right.bound for v in shared):
            condition = condition & reduce(lambda x, y: x | y, (c(v).isNotNull() & c(v + "'").isNotNull() for v in shared))
        return Solutions(left.df.join(r, condition, "left_anti"), left.bound)

    def exists(self, left: Solutions, e: a.Exists, graph) -> Solutions:
        right = self.eval(e.pattern, graph)
        r, shared, condition = self.matched(left, right)
        how = "left_anti" if e.negated else "left_semi"
        return Solutions(left.df.join(r.select(*(c(v + "'") for v in shared)).distinct() if shared else r.limit(1), condition, how), left.bound)

    def union(self, left: Solutions, right: Solutions) -> Solutions:
        return Solutions(left.df.unionByName(right.df, allowMissingColumns=True), left.bound & right.bound)

    # Patterns
    def eval(self, p, graph=None) -> Solutions:
        if isinstance(p, a.BGP):
            return self.bgp(p.triples, graph)
        if isinstance(p, a.Join):
            return self.join(self.eval(p.left, graph), self.eval(p.right, graph))
        if isinstance(p, a.LeftJoin):
            return self.left_join(self.eval(p.left, graph), self.eval(p.right, graph), p.condition)
        if isinstance(p, a.Union):
            return self.union(self.eval(p.left, graph), self.eval(p.right, graph))
        if isinstance(p, a.Minus):
            return self.minus(self.eval(p.left, graph), self.eval(p.right, graph))
        if isinstance(p, a.Graph):
            return self.eval(p.pattern, p.term)
        if isinstance(p, a.Filter):
            got = self.eval(p.pattern, graph)
            for x in self.conjuncts(p.condition):
                if isinstance(x, a.Exists):
                    got = self.exists(got, x, graph)
                else:
                    got = Solutions(got.df.where(F.coalesce(self.expr(x, {v: c(v) for v in got.vars}).truth(), F.lit(False))), got.bound)
            return got
        if isinstance(p, a.Extend):
            got = self.eval(p.pattern, graph)
            return Solutions(got.df.withColumn(p.var, self.expr(p.expression, {v: c(v) for v in got.vars}).term()), got.bound)
        if isinstance(p, a.Values):
            schema = T.StructType([T.StructField(n, T.StringType()) for n in p.names])
            df = self.spark.createDataFrame([tuple(x.nt if x is not None else None for x in r) for r in p.rows], schema)
            return Solutions(df, {n for k, n in enumerate(p.names) if all(r[k] is not None for r in p.rows)})
        if isinstance(p, a.SubSelect):
            return self.select(p.query, graph)
        raise a.SparqlError(f"unknown pattern {p!r}")

    def conjuncts(self, e) -> list:
        if isinstance(e, a.Call) and e.name == "&&":
            return self.conjuncts(e.args[0]) + self.conjuncts(e.args[1])
        if isinstance(e, a.Call) and e.name == "!" and isinstance(e.args[0], a.Exists):
            return [a.Exists(e.args[0].pattern, not e.args[0].negated)]
        return [e]

    # Expressions
    def expr(self, e, env: dict[str, Column]) -> Value:
        if isinstance(e, a.Var):
            return Value("term", env[e.name]) if e.name in env else unbound()
        if isinstance(e, Value):
            return e
        if isinstance(e, a.Term):
            kind, value, dt, _ = parts(e.nt)
            if kind == "lit" and dt in NUMERIC:
                try:
                    return Value("int" if dt == t.XSD + "integer" else "num", F.lit(float(value)))
                except ValueError:
                    pass
            if kind == "lit" and dt == t.XSD + "boolean":
                return Value("bool", F.lit(value in ("true", "1")))
            if kind == "lit" and dt == t.XSD + "string":
                return Value("str", F.lit(value))
            return Value("term", F.lit(e.nt))
        if isinstance(e, a.Exists):
            raise a.SparqlError("EXISTS is supported as a conjunct of a filter only")
        if e.name in a.AGGREGATES:
            raise a.SparqlError("an aggregate outside of SELECT, HAVING and ORDER BY")
        return self.call(e, env)

    def compare(self, op: str, x: Value, y: Value) -> Column:
        ops = {"=": lambda p, q: p == q, "!=": lambda p, q: p != q, "<": lambda p, q: p < q, ">": lambda p, q: p > q, "<=": lambda p, q: p <= q, ">=": lambda p, q: p >= q}
        f = ops[op]
        if x.kind == "bool" or y.kind == "bool":
            return f(x.truth(), y.truth())
        if "term" not in (x.kind, y.kind):
            return f(x.col, y.col) if (x.kind == "str") == (y.kind == "str") else (F.lit(False) if op == "=" else F.lit(True) if op == "!=" else F.lit(None).cast("boolean"))
        n, m = x.number(), y.number()
        if x.kind in ("num", "int") or y.kind in ("num", "int"):
            other = F.lit(None).cast("boolean") if op not in ("=", "!=") else F.when((x if x.kind == "term" else y).col.isNotNull(), F.lit(op == "!="))
            return F.when(n.isNotNull() & m.isNotNull(), f(n, m)).otherwise(other)
        if op in ("=", "!="):
            return F.when(n.isNotNull() & m.isNotNull(), f(n, m)).otherwise(f(x.term(), y.term()))
        plain = F.lit(t.XSD + "string")
        dx = plain if x.kind == "str" else t.datatype(x.col)
        dy = plain if y.kind == "str" else t.datatype(y.col)
        return F.when(n.isNotNull() & m.isNotNull(), f(n, m)).when(dx == dy, f(x.text(), y.text()))

    def call(self, e: a.Call, env) -> Value:  # noqa: C901 - a table of functions
        n = e.name
        args = [self.expr(x, env) for x in e.args]
        x = args[0] if args else unbound()
        if n in ("=", "!=", "<", ">", "<=", ">="):
            return Value("bool", self.compare(n, args[0], args[1]))
        if n == "||":
            return Value("bool", args[0].truth() | args[1].truth())
        if n == "&&":
            return Value("bool", args[0].truth() & args[1].truth())
        if n == "!":
            return Value("bool", ~x.truth())
        if n == "IN":
            return Value("bool", reduce(lambda p, q: p | q, (self.compare("=", x, y) for y in args[1:]), F.lit(False)))
        if n in "+-*/":
            p, q = args[0].number(), args[1].number()
            return Value("num", {"+": lambda: p + q, "-": lambda: p - q, "*": lambda: p * q, "/": lambda: F.try_divide(p, q)}[n]())
        if n == "NEG":
            return Value("num", -x.number())
        if n == "BOUND":
            return Value("bool", x.term().isNotNull())
        if n == "IF":
            kinds = {args[1].kind, args[2].kind}
            pick = (lambda v: v.col) if len(kinds) == 1 else (lambda v: v.term())
            return Value(kinds.pop() if len(kinds) == 1 else "term", F.when(x.truth().isNull(), F.lit(None)).when(x.truth(), pick(args[1])).otherwise(pick(args[2])))
        if n == "COALESCE":
            return Value("term", F.coalesce(*(y.term() for y in args)))
        if n == "SAMETERM":
            return Value("bool", args[0].term() == args[1].term())
        if n in ("ISIRI", "ISURI", "ISBLANK", "ISLITERAL"):
            want = {"ISIRI": "iri", "ISURI": "iri", "ISBLANK": "bnode", "ISLITERAL": "lit"}[n]
            return Value("bool", t.term_kind(x.term()) == want)
        if n == "ISNUMERIC":
            return Value("bool", F.when(x.term().isNotNull(), x.number().isNotNull()))
        if n == "STR":
            return Value("str", x.string())
        if n == "LANG":
            return Value("str", t.language(x.term()))
        if n == "DATATYPE":
            return Value("term", t.iri(t.datatype(x.term())))
        if n in ("IRI", "URI"):
            return Value("term", F.when(F.coalesce(x.term().startswith("<"), F.lit(False)), x.term()).otherwise(t.iri(x.text())))
        if n == "BNODE":
            return Value("term", F.concat(F.lit("_:"), F.concat(F.lit("b"), F.md5(x.text())) if args else F.concat(F.lit("u"), F.replace(F.uuid(), F.lit("-"), F.lit("")))))
        if n == "STRDT":
            return Value("term", F.concat(F.lit('"'), t.escape(x.text()), F.lit('"^^'), args[1].term()))
        if n == "STRLANG":
            return Value("term", F.concat(F.lit('"'), t.escape(x.text()), F.lit('"@'), F.lower(args[1].text())))
        if n == "UUID":
            return Value("term", F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))
        if n == "STRUUID":
            return Value("str", F.uuid())
        s = x.text() if args else F.lit(None)
        y = args[1].text() if len(args) > 1 else F.lit(None)
        if n == "STRLEN":
            return Value("int", F.char_length(s))
        if n == "SUBSTR":
            start = args[1].number().cast("int")
            return Value("str", F.substring(s, start, args[2].number().cast("int") if len(args) > 2 else F.lit(2**31 - 1)))
        if n in ("UCASE", "LCASE"):
            return Value("str", F.upper(s) if n == "UCASE" else F.lower(s))
        if n == "STRSTARTS":
            return Value("bool", s.startswith(y))
        if n == "STRENDS":
            return Value("bool", s.endswith(y))
        if n == "CONTAINS":
            return Value("bool", s.contains(y))
        if n == "STRBEFORE":
            at = F.position(y, s)
            return Value("str", F.when(at > 0, F.substring(s, F.lit(1), at - 1)).otherwise(F.when(s.isNotNull() & y.isNotNull(), "")))
        if n == "STRAFTER":
            at = F.position(y, s)
            return Value("str", F.when(at > 0, F.substring(s, at + F.char_length(y), F.lit(2**31 - 1))).otherwise(F.when(s.isNotNull() & y.isNotNull(), "")))
        if n == "ENCODE_FOR_URI":
            return Value("str", F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")))
        if n == "CONCAT":
            return Value("str", F.concat(*(v.text() for v in args)) if args else F.lit(""))
        if n == "LANGMATCHES":
            return Value("bool", F.when(y == "*", F.length(s) > 0).otherwise((F.lower(s) == F.lower(y)) | F.lower(s).startswith(F.concat(F.lower(y), F.lit("-")))))
        if n in ("REGEX", "REPLACE"):
            k = 2 if n == "REGEX" else 3
            pattern = y
            if len(e.args) > k:
                pattern = F.concat(F.lit("(?"), F.regexp_replace(args[k].text(), "[^ismx]", ""), F.lit(")"), y)
            if n == "REGEX":
                return Value("bool", F.rlike(s, pattern))
            return Value("str", F.regexp_replace(s, pattern, args[2].text()))
        if n in ("ABS", "CEIL", "FLOOR", "ROUND"):
            v = x.number()
            return Value("num", {"ABS": lambda: F.abs(v), "CEIL": lambda: F.ceil(v).cast("double"), "FLOOR": lambda: F.floor(v).cast("double"), "ROUND": lambda: F.floor(v + 0.5).cast("double")}[n]())
        if n == "RAND":
            return Value("num", F.rand())
        if n == "NOW":
            return Value("term", F.concat(F.lit('"'), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), F.lit(f'"^^<{t.XSD}dateTime>')))
        if n in ("YEAR", "MONTH", "DAY", "HOURS", "MINUTES", "SECONDS"):
            place = {"YEAR": r"^(-?\d{4,})-", "MONTH": r"^-?\d{4,}-(\d\d)", "DAY": r"^-?\d{4,}-\d\d-(\d\d)", "HOURS": r"T(\d\d):", "MINUTES": r"T\d\d:(\d\d)", "SECONDS": r"T\d\d:\d\d:(\d\d(?:\.\d+)?)"}[n]
            v = Value("int", F.regexp_extract(s, place, 1).try_cast("double"))
            return v if n != "SECONDS" else self.cast(t.XSD + "decimal", Value("num", v.col))
        if n == "TZ":
            return Value("str", F.when(s.isNotNull(), F.regexp_extract(s, r"(Z|[+-]\d\d:\d\d)$", 1)))
        if n == "TIMEZONE":
            z = F.regexp_extract(s, r"(Z|[+-]\d\d:\d\d)$", 1)
            hours = F.concat(F.when(z.startswith("-"), "-").otherwise(""), F.lit("PT"), F.substring(z, 2, 2).try_cast("int").cast("string"), F.lit("H"))
            return Value("term", F.when(z == "", F.lit(None)).otherwise(F.concat(F.lit('"'), F.when(z.isin("Z", "+00:00"), "PT0S").otherwise(hours), F.lit(f'"^^<{t.XSD}dayTimeDuration>'))))
        if n in ("MD5", "SHA1", "SHA256", "SHA384", "SHA512"):
            return Value("str", F.md5(s) if n == "MD5" else F.sha1(s) if n == "SHA1" else F.sha2(s, int(n[3:])))
        if n.startswith("CAST:"):
            return self.cast(n[5:], x)
        raise a.SparqlError(f"unknown function {n}")

    def cast(self, to: str, x: Value) -> Value:
        s = F.trim(x.string())
        if to == t.XSD + "string":
            return Value("str", x.string())
        if to == t.XSD + "boolean":
            n = x.number()
            return Value("bool", F.when(n.isNotNull(), n != 0).when(s.isin("true", "1"), True).when(s.isin("false", "0"), False))
        if to in NUMERIC:
            v = F.when(x.truth().isNotNull() & F.lit(x.kind == "bool"), x.truth().cast("double")).otherwise(s.try_cast("double")) if x.kind == "bool" else s.try_cast("double")
            return Value("int", F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("double")) if to == t.XSD + "integer" else Value("term", F.regexp_replace(Value("num", v).term(), r"\^\^<[^<>]*>$", f"^^<{to}>"))
        if to == t.XSD + "dateTime":
            return Value("term", F.when(s.rlike(r"^-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?$"), F.concat(F.lit('"'), s, F.lit(f'"^^<{to}>'))))
        raise a.SparqlError(f"unknown cast {to}")

    # Queries
    def aggregate(self, e: a.Call, env) -> Value:
        if e.name == "COUNT" and not e.args:
            if e.distinct:
                return Value("int", F.countDistinct(F.struct(*(F.coalesce(v, F.lit("")) for v in env.values()))))
            return Value("int", F.count("*"))
        v = self.expr(e.args[0], env)
        if e.name == "COUNT":
            return Value("int", F.countDistinct(v.term()) if e.distinct else F.count(v.term()))
        if e.name in ("SUM", "AVG"):
            f = {("SUM", False): F.sum, ("SUM", True): F.sum_distinct, ("AVG", False): F.avg, ("AVG", True): lambda z: F.try_divide(F.sum_distinct(z), F.countDistinct(z))}[e.name, e.distinct]
            return Value("num", F.coalesce(f(v.number()), F.lit(0.0)))
        if e.name in ("MIN", "MAX"):
            key = F.struct(*self.order_key(v), v.term().alias("term"))
            f = F.min if e.name == "MIN" else F.max
            return Value("term", f(F.when(v.term().isNotNull(), key))["term"])
        if e.name == "SAMPLE":
            return Value("term", F.first(v.term(), ignorenulls=True))
        found = F.collect_set(v.string()) if e.distinct else F.collect_list(v.string())
        return Value("str", F.array_join(F.sort_array(found), e.separator))

    @staticmethod
    def order_key(v: Value) -> list[Column]:
        x = v.term()
        rank = F.when(x.isNull(), 0).when(x.startswith("_:"), 1).when(x.startswith("<"), 2).otherwise(3)
        return [rank.alias("rank"), v.number().alias("number"), F.coalesce(v.string(), x).alias("text")]

    def lifted(self, e, found: list) -> object:
        """e with each aggregate replaced by a variable that stands for it."""
        if isinstance(e, a.Call):
            if e.name in a.AGGREGATES:
                found.append((f"_:agg{len(found)}", e))
                return a.Var(found[-1][0])
            return a.Call(e.name, [self.lifted(x, found) for x in e.args], e.distinct, e.separator)
        return e

    def select(self, q: a.Query, graph=None) -> Solutions:
        got = self.eval(q.pattern, graph)
        env = {v: c(v) for v in got.vars}
        aggregates: list = []
        items = [(n, self.lifted(e, aggregates) if e is not None else None) for n, e in q.items]
        having = [self.lifted(e, aggregates) for e in q.having]
        order = [(self.lifted(e, aggregates), up) for e, up in q.order]
        df, bound = got.df, set(got.bound)
        if q.group or aggregates:
            keys, names = [], {}
            for k, (name, e) in enumerate(q.group):
                name = name or f"_:key{k}"
                keys.append(self.expr(e, env).term().alias(name))
                names[name] = e
            values = {n: self.aggregate(e, {v: col for v, col in env.items() if not v.startswith("_:")}) for n, e in aggregates}
            cols = [v.col.alias(n) for n, v in values.items()] or [F.count("*").alias("_:n")]
            df = df.groupBy(*keys).agg(*cols) if keys else df.agg(*cols)
            env = {n: c(n) for n in names}
            typed = {n: Value(v.kind, c(n)) for n, v in values.items()}
            bound &= set(names)
        else:
            typed = {}

        def compiled(e) -> Value:
            if isinstance(e, a.Var) and e.name in typed:
                return typed[e.name]
            if isinstance(e, a.Call):
                return self.call(a.Call(e.name, [typed.get(x.name, x) if isinstance(x, a.Var) else compiled(x) if isinstance(x, a.Call) else x for x in e.args], e.distinct, e.separator), env)
            return self.expr(e, env)

        for e in having:
            df = df.where(F.coalesce(compiled(e).truth(), F.lit(False)))
        for n, e in items:
            if e is not None:
                value = compiled(e)
                df = df.withColumn(n, value.term())
                env[n] = c(n)
                typed = dict(typed)
        shown = [n for n, _ in items] if items else [v for v in df.columns if not v.startswith("_:")]
        for n in shown:
            if n not in df.columns:
                df = df.withColumn(n, F.lit(None).cast("string"))
        if q.distinct:
            if any(not (isinstance(e, a.Var) and e.name in shown) for e, _ in order):
                raise a.SparqlError("DISTINCT can be ordered by selected variables only")
            df = df.select(*(c(n) for n in shown)).distinct()
        if order:
            sort = []
            for e, up in order:
                for k in self.order_key(compiled(e)):
                    sort.append(k.asc_nulls_first() if up else k.desc_nulls_last())
            df = df.orderBy(*sort)
        df = df.select(*(c(n) for n in shown)) if shown else df.select(F.lit(1).alias("_:one"))
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Solutions(df, bound & set(shown))

    def ground(self, template: list[a.Triple], got: Solutions) -> DataFrame:
        """subject, predicate, object of every instance of the template that is a triple."""
        out = None
        df = got.df.withColumn("_:row", F.monotonically_increasing_id()) if any(isinstance(x, a.Var) and x.name.startswith("_:") and x.name not in got.vars for tr in template for x in (tr.s, tr.o)) else got.df
        env = {v: c(v) for v in got.vars}

        def term(x) -> Column:
            if isinstance(x, a.Term):
                return F.lit(x.nt)
            if x.name in env:
                return env[x.name]
            return F.concat(F.lit("_:" + re.sub(r"\W", "", x.name) + "r"), c("_:row").cast("string")) if x.name.startswith("_:") else F.lit(None).cast("string")

        for tr in template:
            part = df.select(term(tr.s).alias("subject"), term(tr.p).alias("predicate"), term(tr.o).alias("object"))
            part = part.where(~F.col("subject").startswith('"') & F.col("predicate").startswith("<") & F.col("object").isNotNull())
            out = part if out is None else out.unionByName(part)
        return (out if out is not None else self.spark.createDataFrame([], t.TRIPLE)).distinct()

    def run(self, q: a.Query) -> DataFrame:
        if q.default_graphs or q.named_graphs:
            self.from_default, self.from_named = q.default_graphs, q.named_graphs
        if q.form == "SELECT":
            return self.select(q).df
        if q.form == "ASK":
            return self.eval(q.pattern).df.limit(1).agg((F.count("*") > 0).alias("ask"))
        if q.form == "CONSTRUCT":
            inner = a.Query("SELECT", q.pattern, order=q.order, limit=q.limit, offset=q.offset)
            got = self.eval(q.pattern) if q.limit is None and not q.offset else self.select(inner)
            return self.ground(q.template, got)
        got = self.eval(q.pattern)
        wanted = None
        for x in q.describe or [a.Var(v) for v in got.vars if not v.startswith("_:")]:
            part = self.spark.createDataFrame([(x.nt,)], "subject string") if isinstance(x, a.Term) else got.df.select(c(x.name).alias("subject"))
            wanted = part if wanted is None else wanted.union(part)
        every = self.active(None).select(t.subject_term().alias("subject"), t.iri("p").alias("predicate"), t.object_term().alias("object"))
        return every.join(wanted.distinct(), "subject", "left_semi").distinct()


def query(quads: DataFrame, text: str, dataset: str = "default") -> DataFrame:
    """The solutions of a SELECT (a column per variable), ``ask`` of an ASK, triples of CONSTRUCT and DESCRIBE."""
    return Translator(quads, dataset).run(a.parse(text))


def results_json(solutions: DataFrame) -> DataFrame:
    """One JSON object per solution, keys with their question mark, unbound variables left out."""
    return solutions.select(F.to_json(F.struct(*(c(v).alias("?" + v) for v in solutions.columns))).alias("binding"))


def results_array(solutions: DataFrame) -> str:
    """All solutions as one JSON array; for results that fit the driver."""
    return json.dumps([json.loads(r["binding"]) for r in results_json(solutions).toLocalIterator()])
