"""SPARQL 1.1 queries to algebra."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from quadloom.functions.terms import RDF, RDF_TYPE, XSD


class SparqlError(ValueError):
    pass


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Term:
    """A constant in N-Triples form."""

    nt: str


@dataclass
class PathIri:
    iri: str


@dataclass
class PathInverse:
    path: Any


@dataclass
class PathSequence:
    parts: list


@dataclass
class PathAlternative:
    parts: list


@dataclass
class PathNegated:
    forward: list[str]
    backward: list[str]


@dataclass
class PathRepeat:
    path: Any
    least: int
    many: bool


@dataclass
class Triple:
    s: Any
    p: Any
    o: Any


@dataclass
class BGP:
    triples: list[Triple]


@dataclass
class Join:
    left: Any
    right: Any


@dataclass
class LeftJoin:
    left: Any
    right: Any
    condition: Any = None


@dataclass
class Union:
    left: Any
    right: Any


@dataclass
class Minus:
    left: Any
    right: Any


@dataclass
class Filter:
    condition: Any
    pattern: Any


@dataclass
class Graph:
    term: Any
    pattern: Any


@dataclass
class Extend:
    pattern: Any
    var: str
    expression: Any


@dataclass
class Values:
    names: list[str]
    rows: list[list]


@dataclass
class SubSelect:
    query: Any


@dataclass
class Call:
    """An operator or function applied to arguments."""

    name: str
    args: list
    distinct: bool = False
    separator: str = " "


@dataclass
class Exists:
    pattern: Any
    negated: bool


@dataclass
class Query:
    form: str
    pattern: Any
    items: list = field(default_factory=list)  # (name, expression or None); empty: *
    distinct: bool = False
    group: list = field(default_factory=list)  # (name or None, expression)
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)  # (expression, ascending)
    limit: int | None = None
    offset: int = 0
    template: list[Triple] = field(default_factory=list)
    describe: list = field(default_factory=list)
    default_graphs: list[str] = field(default_factory=list)
    named_graphs: list[str] = field(default_factory=list)


AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}
_TOKEN = re.compile(
    r"""
    (?P<space>\s+|\#[^\n]*)
  | (?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
  | (?P<var>[?$][A-Za-z0-9_\u00b7-\uffff]+)
  | (?P<str>\"\"\"(?:[^"\\]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  | (?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<num>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)|\d*\.\d+|\d+)
  | (?P<bnode>_:[A-Za-z0-9_.\-]*[A-Za-z0-9_\-])
  | (?P<pname>(?:[A-Za-z](?:[\w.\-]*[\w\-])?)?:(?:(?:[\w:\-]|%[0-9A-Fa-f]{2}|\\.)(?:(?:[\w.:\-]|%[0-9A-Fa-f]{2}|\\.)*(?:[\w:\-]|%[0-9A-Fa-f]{2}|\\.))?)?)
  | (?P<word>[A-Za-z][A-Za-z0-9_]*)
  | (?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,|/^?*+!=<>\-])
    """,
    re.VERBOSE,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _unescaped(s: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), s, flags=re.S)


def literal(text: str, datatype: str | None = None, lang: str | None = None) -> str:
    body = text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    if lang:
        return f'"{body}"@{lang}'
    return f'"{body}"' if datatype in (None, XSD + "string") else f'"{body}"^^<{datatype}>'


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SparqlError(f"can't read {text[at:at + 30]!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at, self.prefixes, self.base, self.fresh = 0, {}, "", 0

    # Tokens
    def peek(self, *values: str) -> bool:
        kind, value = self.tokens[self.at]
        return (value.upper() if kind == "word" else value) in values and kind != "str"

    def kind(self) -> str:
        return self.tokens[self.at][0]

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.at += 1
            return True
        return False

    def expect(self, value: str) -> None:
        if not self.take(value):
            raise SparqlError(f"expected {value!r} at {' '.join(v for _, v in self.tokens[self.at:self.at + 5])!r}")

    def blank(self) -> Var:
        self.fresh += 1
        return Var(f"_:b{self.fresh}")

    # Query forms
    def parse(self) -> Query:
        self.prologue()
        q = self.query()
        if self.kind() != "end":
            raise SparqlError(f"unexpected {self.tokens[self.at][1]!r}")
        return q

    def prologue(self) -> None:
        while True:
            if self.take("PREFIX"):
                name = self.next()[1]
                self.prefixes[name[:-1]] = self.resolve(self.next()[1])
            elif self.take("BASE"):
                self.base = self.next()[1][1:-1]
            else:
                return

    def resolve(self, token: str) -> str:
        iri = _unescaped(token[1:-1])
        return iri if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", iri) or not self.base else self.base + iri

    def query(self) -> Query:
        if self.take("SELECT"):
            return self.select()
        if self.take("ASK"):
            q = Query("ASK", None)
            self.datasets(q)
            self.take("WHERE")
            q.pattern = self.group()
            self.modifiers(q)
            return q
        if self.take("CONSTRUCT"):
            q = Query("CONSTRUCT", None)
            if self.peek("{"):
                q.template = self.template()
                self.datasets(q)
                self.take("WHERE")
                q.pattern = self.group()
            else:
                self.datasets(q)
                self.expect("WHERE")
                q.template = self.template()
                q.pattern = BGP(q.template)
            self.modifiers(q)
            return q
        if self.take("DESCRIBE"):
            q = Query("DESCRIBE", BGP([]))
            while self.kind() in ("var", "iri", "pname"):
                q.describe.append(self.var_or_term())
            if not q.describe:
                self.expect("*")
            self.datasets(q)
            if self.peek("WHERE", "{"):
                self.take("WHERE")
                q.pattern = self.group()
            self.modifiers(q)
            return q
        raise SparqlError("not a query")

    def select(self) -> Query:
        q = Query("SELECT", None)
        q.distinct = self.take("DISTINCT", "REDUCED")
        if not self.take("*"):
            while True:
                if self.kind() == "var":
                    q.items.append((self.next()[1][1:], None))
                elif self.take("("):
                    e = self.expression()
                    self.expect("AS")
                    q.items.append((self.next()[1][1:], e))
                    self.expect(")")
                else:
                    break
            if not q.items:
                raise SparqlError("nothing selected")
        self.datasets(q)
        self.take("WHERE")
        q.pattern = self.group()
        self.modifiers(q)
        if self.peek("VALUES"):
            q.pattern = Join(q.pattern, self.values())
        return q

    def datasets(self, q: Query) -> None:
        while self.take("FROM"):
            (q.named_graphs if self.take("NAMED") else q.default_graphs).append(self.iri())

    def modifiers(self, q: Query) -> None:
        if self.take("GROUP"):
            self.expect("BY")
            while True:
                if self.kind() == "var":
                    name = self.next()[1][1:]
                    q.group.append((name, Var(name)))
                elif self.take("("):
                    e, name = self.expression(), None
                    if self.take("AS"):
                        name = self.next()[1][1:]
                    self.expect(")")
                    q.group.append((name, e))
                elif self.kind() in ("word", "iri", "pname") and not self.peek("HAVING", "ORDER", "LIMIT", "OFFSET", "VALUES"):
                    q.group.append((None, self.primary()))
                else:
                    break
        if self.take("HAVING"):
            while self.peek("(") or (self.kind() == "word" and not self.peek("ORDER", "LIMIT", "OFFSET", "VALUES")):
                q.having.append(self.constraint())
        if self.take("ORDER"):
            self.expect("BY")
            while True:
                if self.peek("ASC", "DESC"):
                    up = self.next()[1].upper() == "ASC"
                    self.expect("(")
                    q.order.append((self.expression(), up))
                    self.expect(")")
                elif self.kind() == "var":
                    q.order.append((Var(self.next()[1][1:]), True))
                elif self.peek("(") or (self.kind() in ("word", "iri", "pname") and not self.peek("LIMIT", "OFFSET", "VALUES")):
                    q.order.append((self.constraint(), True))
                else:
                    break
        while self.peek("LIMIT", "OFFSET"):
            if self.take("LIMIT"):
                q.limit = int(self.next()[1])
            else:
                self.expect("OFFSET")
                q.offset = int(self.next()[1])

    # Patterns
    def group(self) -> Any:
        self.expect("{")
        if self.take("SELECT"):
            sub = SubSelect(self.select())
            self.expect("}")
            return sub
        pattern: Any = BGP([])
        filters = []
        while not self.take("}"):
            if self.take("OPTIONAL"):
                inner = self.group()
                if isinstance(inner, Filter):
                    pattern = LeftJoin(pattern, inner.pattern, inner.condition)
                else:
                    pattern = LeftJoin(pattern, inner)
            elif self.take("MINUS"):
                pattern = Minus(pattern, self.group())
            elif self.take("GRAPH"):
                term = self.var_or_term()
                pattern = self.joined(pattern, Graph(term, self.group()))
            elif self.take("FILTER"):
                filters.append(self.constraint())
            elif self.take("BIND"):
                self.expect("(")
                e = self.expression()
                self.expect("AS")
                pattern = Extend(pattern, self.next()[1][1:], e)
                self.expect(")")
            elif self.peek("VALUES"):
                pattern = self.joined(pattern, self.values())
            elif self.take("SERVICE"):
                raise SparqlError("SERVICE is not supported")
            elif self.peek("{"):
                inner = self.group()
                while self.take("UNION"):
                    inner = Union(inner, self.group())
                pattern = self.joined(pattern, inner)
            else:
                triples = self.triples()
                if isinstance(pattern, BGP):
                    pattern = BGP(pattern.triples + triples)
                else:
                    pattern = self.joined(pattern, BGP(triples))
            self.take(".")
        for f in filters:
            pattern = Filter(Call("&&", [pattern.condition, f]), pattern.pattern) if isinstance(pattern, Filter) and filters.index(f) else Filter(f, pattern)
        return pattern

    @staticmethod
    def joined(left: Any, right: Any) -> Any:
        return right if isinstance(left, BGP) and not left.triples else Join(left, right)

    def values(self) -> Values:
        self.expect("VALUES")
        if self.kind() == "var":
            names, one = [self.next()[1][1:]], True
        else:
            self.expect("(")
            names, one = [], False
            while self.kind() == "var":
                names.append(self.next()[1][1:])
            self.expect(")")
        self.expect("{")
        rows = []
        while not self.take("}"):
            if one:
                rows.append([None if self.take("UNDEF") else self.var_or_term()])
            else:
                self.expect("(")
                row = []
                while not self.take(")"):
                    row.append(None if self.take("UNDEF") else self.var_or_term())
                rows.append(row)
        return Values(names, rows)

    def template(self) -> list[Triple]:
        self.expect("{")
        out: list[Triple] = []
        while not self.take("}"):
            out += self.triples()
            self.take(".")
        return out

    def triples(self) -> list[Triple]:
        out: list[Triple] = []
        if self.peek("[", "("):
            subject = self.node(out)
            if self.peek(".", "}"):
                return out
        else:
            subject = self.var_or_term()
        self.properties(subject, out)
        return out

    def properties(self, subject: Any, out: list[Triple]) -> None:
        while True:
            if self.kind() == "var":
                verb: Any = Var(self.next()[1][1:])
            else:
                verb = self.path()
                verb = Term(f"<{verb.iri}>") if isinstance(verb, PathIri) else verb
            while True:
                out.append(Triple(subject, verb, self.node(out)))
                if not self.take(","):
                    break
            again = False
            while self.take(";"):
                again = True
            if not again or self.peek(".", "}", "]"):
                return

    def node(self, out: list[Triple]) -> Any:
        if self.take("["):
            b = self.blank()
            if not self.take("]"):
                self.properties(b, out)
                self.expect("]")
            return b
        if self.take("("):
            items = []
            while not self.take(")"):
                items.append(self.node(out))
            head: Any = Term(f"<{RDF}nil>")
            for x in reversed(items):
                b = self.blank()
                out += [Triple(b, Term(f"<{RDF}first>"), x), Triple(b, Term(f"<{RDF}rest>"), head)]
                head = b
            return head
        return self.var_or_term()

    def path(self) -> Any:
        parts = [self.path_sequence()]
        while self.take("|"):
            parts.append(self.path_sequence())
        return parts[0] if len(parts) == 1 else PathAlternative(parts)

    def path_sequence(self) -> Any:
        parts = [self.path_element()]
        while self.take("/"):
            parts.append(self.path_element())
        return parts[0] if len(parts) == 1 else PathSequence(parts)

    def path_element(self) -> Any:
        if self.take("^"):
            return PathInverse(self.path_element())
        if self.take("("):
            p = self.path()
            self.expect(")")
        elif self.take("!"):
            forward, backward = [], []
            many = self.take("(")
            while True:
                back = self.take("^")
                (backward if back else forward).append(RDF_TYPE if self.take_a() else self.iri())
                if not many or self.take(")"):
                    break
                self.expect("|")
            p = PathNegated(forward, backward)
        else:
            p = PathIri(RDF_TYPE if self.take_a() else self.iri())
        if self.take("?"):
            return PathRepeat(p, 0, False)
        if self.take("*"):
            return PathRepeat(p, 0, True)
        if self.take("+"):
            return PathRepeat(p, 1, True)
        return p

    def take_a(self) -> bool:
        if self.tokens[self.at] == ("word", "a"):
            self.at += 1
            return True
        return False

    # Terms
    def iri(self) -> str:
        kind, value = self.next()
        if kind == "iri":
            return self.resolve(value)
        if kind == "pname":
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise SparqlError(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise SparqlError(f"expected an IRI, found {value!r}")

    def var_or_term(self) -> Any:
        kind, value = self.tokens[self.at]
        if kind == "var":
            self.at += 1
            return Var(value[1:])
        if kind in ("iri", "pname"):
            return Term(f"<{self.iri()}>")
        if kind == "bnode":
            self.at += 1
            return Var("_:" + value[2:])
        if kind == "str":
            self.at += 1
            text = _unescaped(value[3:-3] if value[:3] in ('"""', "'''") else value[1:-1])
            if self.kind() == "lang":
                return Term(literal(text, lang=self.next()[1][1:].lower()))
            if self.take("^^"):
                return Term(literal(text, self.iri()))
            return Term(literal(text))
        if kind == "num" or (value in ("-", "+") and self.tokens[self.at + 1][0] == "num"):
            sign = self.next()[1] if kind != "num" else ""
            value = sign.replace("+", "") + self.next()[1]
            return Term(literal(value, XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer")))
        if self.peek("TRUE", "FALSE"):
            return Term(literal(self.next()[1].lower(), XSD + "boolean"))
        if self.take("["):
            self.expect("]")
            return self.blank()
        raise SparqlError(f"expected a term, found {value!r}")

    # Expressions
    def constraint(self) -> Any:
        if self.take("("):
            e = self.expression()
            self.expect(")")
            return e
        return self.primary()

    def expression(self) -> Any:
        e = self.conjunction()
        while self.take("||"):
            e = Call("||", [e, self.conjunction()])
        return e

    def conjunction(self) -> Any:
        e = self.relation()
        while self.take("&&"):
            e = Call("&&", [e, self.relation()])
        return e

    def relation(self) -> Any:
        e = self.additive()
        for op in ("=", "!=", "<=", ">=", "<", ">"):
            if self.take(op):
                return Call(op, [e, self.additive()])
        if self.take("IN"):
            return Call("IN", [e, *self.arguments()])
        if self.take("NOT"):
            self.expect("IN")
            return Call("!", [Call("IN", [e, *self.arguments()])])
        return e

    def additive(self) -> Any:
        e = self.multiplicative()
        while self.peek("+", "-"):
            e = Call(self.next()[1], [e, self.multiplicative()])
        return e

    def multiplicative(self) -> Any:
        e = self.unary()
        while self.peek("*", "/"):
            e = Call(self.next()[1], [e, self.unary()])
        return e

    def unary(self) -> Any:
        if self.take("!"):
            return Call("!", [self.unary()])
        if self.take("-"):
            return Call("NEG", [self.unary()])
        if self.take("+"):
            return self.unary()
        return self.primary()

    def arguments(self) -> list:
        self.expect("(")
        out = []
        while not self.take(")"):
            out.append(self.expression())
            self.take(",")
        return out

    def primary(self) -> Any:
        if self.take("("):
            e = self.expression()
            self.expect(")")
            return e
        kind, value = self.tokens[self.at]
        if kind == "word" and not self.peek("TRUE", "FALSE"):
            name = self.next()[1].upper()
            if name == "EXISTS":
                return Exists(self.group(), False)
            if name == "NOT":
                self.expect("EXISTS")
                return Exists(self.group(), True)
            if name in AGGREGATES:
                self.expect("(")
                call = Call(name, [], self.take("DISTINCT"))
                call.args = [] if self.take("*") else [self.expression()]
                if self.take(";"):
                    self.expect("SEPARATOR")
                    self.expect("=")
                    call.separator = _unescaped(self.next()[1][1:-1])
                self.expect(")")
                return call
            return Call(name, self.arguments())
        if kind in ("iri", "pname"):
            i = self.iri()
            return Call("CAST:" + i, self.arguments()) if self.peek("(") else Term(f"<{i}>")
        return self.var_or_term()


def parse(text: str) -> Query:
    return Parser(text).parse()
