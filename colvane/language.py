"""Expressions in a terse array language, compiled to columns.

    Language(df).select("vec_id", "norm", "(+/x*x)^0.5", "embedding is x")

Text is read right to left without precedence: `2*3+4` is 14. Operators, adverbs, conditionals and functions become
Catalyst expressions over the row's columns; nothing is evaluated by the driver. Values know their depth (0 for atoms)
and kind when the text is compiled, so counts of `#`, `_`, `:+`, `:#` and dimensions of `:^` must be literals.

Statements are separated by `;`, `a::e` names a value, `:"..."` is a comment, `{x+y}` a function (arguments x, y, z, locals
in brackets first), `f(1;2)` a call, `f(;2)` a projection, `:[c;a;b]` a choice with `:|` for further ones, `[1 2 3]` a
list, `[;a;b]` a list of evaluated parts, `0cx` a character, `"..."` text, `:name` a symbol.
"""

from __future__ import annotations

import functools
import importlib
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colvane.functions import scalars as S
from colvane.operators import nested as A

#: The operators and adverbs of the language, longer ones first.
VERBS = [":%", ":^", ":+", ":#", ":_", ":=", ":-", ":@", ":$", "::", *"!#$%&*+,-<=>?@^_|~"]
ADVERBS = [":\\", ":/", ":'", ":~", ":*", "\\~", "\\*", "@'", "'", "/", "\\"]
NUMBER = re.compile(r"-?\d+(\.\d+)?(e[+-]?\d+)?")
NAME = re.compile(r"\.?[A-Za-z][A-Za-z0-9.]*")


@dataclass
class Value:
    col: Column
    depth: int
    kind: str  # i long, d double, s text, y symbol
    const: object = None  # the literal, where the text has one

    def element(self, col: Column) -> Value:
        return Value(col, self.depth - 1, self.kind)


@dataclass
class Function:
    run: Callable[..., Value | Function]
    arity: int

    def __call__(self, *args):
        if len(args) < self.arity or any(a is None for a in args):  # a projection
            given = [*args, *[None] * (self.arity - len(args))]
            holes = [i for i, a in enumerate(given) if a is None]

            def rest(*more):
                full = list(given)
                for i, a in zip(holes, more, strict=True):
                    full[i] = a
                return self.run(*full)

            return Function(rest, len(holes))
        return self.run(*args)


class LanguageError(ValueError):
    pass


# atomic operators descend into lists


def atomic1(f, kind: Callable[[str], str], a: Value) -> Value:
    if a.depth == 0:
        return Value(f(a.col), 0, kind(a.kind))
    return Value(F.transform(a.col, lambda x: atomic1(f, kind, a.element(x)).col), a.depth, kind(a.kind))


def atomic2(f, kind: Callable[[str, str], str], a: Value, b: Value) -> Value:
    made = kind(a.kind, b.kind)
    if a.depth == 0 and b.depth == 0:
        return Value(f(a.col, b.col), 0, made)
    if b.depth == 0:
        return Value(F.transform(a.col, lambda x: atomic2(f, kind, a.element(x), b).col), a.depth, made)
    if a.depth == 0:
        return Value(F.transform(b.col, lambda y: atomic2(f, kind, a, b.element(y)).col), b.depth, made)
    return Value(F.zip_with(a.col, b.col, lambda x, y: atomic2(f, kind, a.element(x), b.element(y)).col), max(a.depth, b.depth), made)


def wider(a: str, b: str) -> str:
    return a if a == b else "d"


def literal(v: Value, what: str):
    if v.const is None:
        raise LanguageError(f"{what} must be a literal")
    return v.const


def text(v: Value) -> bool:
    return v.depth == 0 and v.kind == "s"


def each_of(a: Value, f) -> Value:
    """A list of f's values over a's elements."""
    if a.depth == 0:
        if a.kind != "s":
            return f(a)
        a = Value(F.split(a.col, ""), 1, "s")
    made: list[Value] = []

    def step(x):
        made.append(f(a.element(x)))
        return made[-1].col

    col = F.transform(a.col, step)
    return Value(col, made[-1].depth + 1, made[-1].kind)


def as_kind(a: Value, kind: str) -> Value:
    return a if a.kind == kind or kind != "d" else atomic1(lambda x: x.cast("double"), lambda _: "d", a)


def size(a: Value) -> Value:
    if a.depth:
        return Value(F.size(a.col).cast("long"), 0, "i")
    return Value(F.length(a.col).cast("long"), 0, "i") if a.kind == "s" else Value(F.abs(a.col), 0, a.kind)


def shape(a: Value) -> Value:
    if a.depth > 2:
        raise LanguageError("shapes are of two dimensions at most")
    return size(a) if text(a) else Value(F.lit(0).cast("long"), 0, "i") if a.depth == 0 else Value(F.transform(A.shape(a.col) if a.depth == 2 else F.array(F.size(a.col)), lambda n: n.cast("long")), 1, "i")


def negation(a: Value) -> Value:
    if a.depth:
        return atomic1(S.not_, lambda _: "i", a)
    return Value(S.not_text(a.col) if a.kind == "s" else S.not_(a.col) if a.kind in "id" else F.lit(0).cast("long"), 0, "i")


def whole(f) -> Callable[[Value], Value]:
    return lambda a: Value(f(a.col), a.depth, a.kind)


def longs(f, depth: int = 1) -> Callable[[Value], Value]:
    return lambda a: Value(f(a.col), depth, "i")


MONADS: dict[str, Callable[[Value], Value]] = {
    "@": lambda a: Value(S.atom_list(a.col) if a.depth else S.not_text(a.col) if a.kind == "s" else F.lit(1).cast("long"), 0, "i"),
    ":#": lambda a: atomic1(S.char, lambda _: "s", a),
    "!": longs(lambda c: A.enumerate_(c)),
    "&": longs(A.expand),
    "*": lambda a: Value(A.first(a.col), a.depth - 1, a.kind) if a.depth else Value(F.substring(a.col, 1, 1), 0, "s") if a.kind == "s" else a,
    "_": lambda a: atomic1(S.floor, lambda _: "i", a),
    "$": lambda a: atomic1(lambda c: S.format_(c, a.kind == "y"), lambda _: "s", a),
    "<": longs(A.grade_up),
    ">": longs(A.grade_down),
    "=": longs(A.group, 2),
    ",": lambda a: Value(F.array(a.col), a.depth + 1, a.kind),
    "-": lambda a: atomic1(S.negate, lambda k: k, a),
    "~": negation,
    "?": lambda a: Value(S.unique_chars(a.col) if a.depth == 0 else A.unique(a.col), a.depth, a.kind),
    "%": lambda a: atomic1(S.reciprocal, lambda _: "d", a),
    "|": lambda a: a if a.depth == 0 and a.kind != "s" else Value(A.reverse(a.col), a.depth, a.kind),
    "^": shape,
    "#": size,
    "+": whole(A.transpose),
    ":_": lambda a: Value(S.undefined(a.col), 0, "i"),
}


def joined(a: Value, b: Value) -> Value:
    if text(a) and text(b):
        return Value(F.concat(a.col, b.col), 0, "s")
    kind = wider(a.kind, b.kind)
    a, b = as_kind(a, kind), as_kind(b, kind)
    depth = max(a.depth, b.depth, 1)
    side = lambda v: F.array(v.col) if v.depth < depth else v.col
    if min(a.depth, b.depth) < depth - 1:
        raise LanguageError("these depths can't be joined")
    return Value(F.concat(side(a), side(b)), depth, kind)


def taken(n: Value, a: Value) -> Value:
    k = literal(n, "the count of #")
    return Value(S.take_text(a.col, k), 0, "s") if text(a) else Value(A.take(a.col, k), a.depth, a.kind)


def dropped(n: Value, a: Value) -> Value:
    k = literal(n, "the count of _")
    return Value(S.drop_text(a.col, k), 0, "s") if text(a) else Value(A.drop(a.col, k), a.depth, a.kind)


def rotated(n: Value, a: Value) -> Value:
    k = literal(n, "the count of :+")
    return Value(S.rotate_text(a.col, k), 0, "s") if text(a) else Value(A.rotate(a.col, k), a.depth, a.kind)


def split(n: Value, a: Value) -> Value:
    k = literal(n, "the size of :#")
    if isinstance(k, list):
        raise LanguageError("a list of sizes is for distributed vectors")
    return Value(S.split_text(a.col, k), 1, "s") if text(a) else Value(A.split(a.col, k), a.depth + 1, a.kind)


def reshaped(n: Value, a: Value) -> Value:
    dims = literal(n, "the shape")
    dims = dims if isinstance(dims, list) else [dims]
    flat = a
    while flat.depth > 1:
        flat = Value(F.flatten(flat.col), flat.depth - 1, flat.kind)
    flat = flat if flat.depth else Value(F.array(flat.col), 1, flat.kind)
    total = functools.reduce(lambda p, q: p * q, dims)
    if total <= 0:
        raise LanguageError("dimensions must be positive")
    out = Value(A.take(flat.col, total), 1, a.kind)
    for k in reversed(dims[1:]):
        out = Value(A.split(out.col, k), out.depth + 1, out.kind)
    return out


def indexed(a: Value | Function, b: Value):
    if isinstance(a, Function):
        return a(*[b.element(F.get(b.col, i)) for i in range(a.arity)]) if b.depth else a(b)
    if text(a):
        pick = lambda i: F.substring(a.col, (i + 1).cast("int"), F.lit(1))
        return Value(pick(b.col), 0, "s") if b.depth == 0 else Value(F.array_join(F.transform(b.col, pick), ""), 0, "s")
    return a.element(F.get(a.col, b.col.cast("int"))) if b.depth == 0 else Value(A.at(a.col, b.col), a.depth, a.kind)


def amended(a: Value, b: Value) -> Value:
    new, *places = literal(b, "what := puts in")
    if text(a):
        return Value(S.overwrite_text(a.col, str(new), places[0]), 0, "s")
    return Value(A.amend(a.col, F.lit(new).cast("double" if a.kind == "d" else "long" if a.kind == "i" else "string"), F.array(*map(F.lit, places))), a.depth, a.kind)


def amended_deep(a: Value, b: Value) -> Value:
    new, *places = literal(b, "what :- puts in")
    return Value(A.amend_depth(a.col, F.lit(new).cast("double" if a.kind == "d" else "long"), *places), a.depth, a.kind)


def found(a: Value, b: Value) -> Value:
    return Value(F.transform(S.find_text(a.col, literal(b, "the text to find")) if text(a) else A.find(a.col, b.col), lambda i: i.cast("long")), 1, "i")


def formed(a: Value, b: Value) -> Value:
    return Value(S.form_int(b.col), 0, "i") if a.kind == "i" else Value(S.form_real(b.col), 0, "d") if a.kind == "d" else b


def padded(a: Value, b: Value) -> Value:
    k = literal(a, "the width of $")
    if isinstance(k, float):
        n, _, digits = str(k).partition(".")
        return Value(S.fixed(b.col, int(n), int(digits)), 0, "s")
    return Value(S.pad(b.col.cast("string"), k), 0, "s")


def deep_index(a: Value, b: Value) -> Value:
    places = literal(b, "the place of :@")
    places = places if isinstance(places, list) else [places]
    return Value(A.at_depth(a.col, *places), a.depth - len(places), a.kind)


def compared(f):
    return lambda a, b: atomic2(f, lambda *_: "i", a, b)


def numeric(f, kind=wider):
    return lambda a, b: atomic2(f, kind, a, b)


DYADS: dict[str, Callable[[Value, Value], Value]] = {
    "+": numeric(S.plus),
    "-": numeric(S.minus),
    "*": numeric(S.times),
    "%": numeric(S.divide, lambda *_: "d"),
    ":%": numeric(S.int_divide, lambda *_: "i"),
    "!": numeric(S.remainder),
    "^": numeric(S.power, lambda *_: "d"),
    "|": numeric(S.max_or),
    "&": numeric(S.min_and),
    "=": compared(S.equal),
    "<": compared(S.less),
    ">": compared(S.more),
    "~": lambda a, b: Value(S.truth(a.col.eqNullSafe(b.col)) if a.depth == b.depth and (a.kind == b.kind or {a.kind, b.kind} == {"i", "d"}) else F.lit(0).cast("long"), 0, "i"),
    ":=": amended,
    ":-": amended_deep,
    ":_": lambda a, b: Value(A.cut(b.col, a.col if a.depth else F.array(a.col)), b.depth + 1, b.kind),
    "@": indexed,
    ":@": deep_index,
    "_": dropped,
    "?": found,
    ":$": formed,
    "$": padded,
    ",": joined,
    ":^": reshaped,
    ":+": rotated,
    ":#": split,
    "#": taken,
}


def folded(f: Function, a: Value, start: Value | None, every: bool) -> Value:
    """Over and scan; the list takes the kind of f's values, so `%/` of whole numbers is real."""
    if a.depth == 0:
        return a
    made = f(a.element(F.get(a.col, 0)), a.element(F.get(a.col, 0)))
    a = as_kind(a, made.kind)
    start = as_kind(start, made.kind) if start is not None else None
    step = lambda p, q: f(Value(p, made.depth, made.kind), a.element(q)).col
    return Value((A.scan if every else A.over)(a.col, step, start.col if start is not None else None), made.depth + every, made.kind)


def with_adverb(f: Function, adverb: str) -> Function:
    """The function that an adverb makes; it is used with one argument or two."""

    def run(*args):
        b = args[-1]
        a = args[0] if len(args) == 2 else None
        if adverb == "'":
            if a is None:
                return each_of(b, f)
            made: list[Value] = []

            def pair(x, y):
                made.append(f(a.element(x), b.element(y)))
                return made[-1].col

            col = A.each2(a.col, b.col, pair)
            return Value(col, made[-1].depth + 1, made[-1].kind)
        if adverb == ":\\":
            return each_of(b, lambda y: f(a, y))
        if adverb == ":/":
            return each_of(b, lambda y: f(y, a))
        if adverb == ":'":
            made = f(b.element(F.get(b.col, 0)), b.element(F.get(b.col, 0)))
            return Value(A.each_pair(b.col, lambda x, y: f(b.element(x), b.element(y)).col), made.depth + 1, made.kind)
        if adverb == "@'":
            made = f(Value(F.lit(0).cast("long"), 0, "i"), b.element(F.get(b.col, 0)))
            return Value(F.transform(b.col, lambda x, i: f(Value(i.cast("long"), 0, "i"), b.element(x)).col), made.depth + 1, made.kind)
        if adverb in "/\\":
            return folded(f, b, a, adverb == "\\")
        again = lambda c: f(Value(c, b.depth, b.kind)).col
        b = as_kind(b, f(b).kind)
        many = b.depth + (adverb[0] == "\\")
        if adverb[1] == "*":
            n = literal(a, "the number of rounds")
            return Value((A.scan_iterate if adverb[0] == "\\" else A.iterate)(n, b.col, again), many, b.kind)
        if a is None:
            return Value((A.scan_converge if adverb[0] == "\\" else A.converge)(b.col, again), many, b.kind)
        test = lambda c: a(Value(c, b.depth, b.kind)).col != 0
        return Value((A.scan_while if adverb[0] == "\\" else A.while_)(b.col, test, again), many, b.kind)

    return Function(run, 1)


class Parser:
    """One text; each method reads a part of it and gives a value in the scope it is handed."""

    def __init__(self, source: str):
        self.s, self.i = source, 0

    def space(self) -> None:
        while self.i < len(self.s):
            if self.s[self.i].isspace():
                self.i += 1
            elif self.s.startswith(':"', self.i):
                self.i = self.s.index('"', self.i + 2) + 1
            else:
                return

    def peek(self, *options: str) -> str | None:
        self.space()
        return next((o for o in options if self.s.startswith(o, self.i)), None)

    def take(self, *options: str) -> str | None:
        got = self.peek(*options)
        self.i += len(got or "")
        return got

    def need(self, option: str) -> None:
        if not self.take(option):
            raise LanguageError(f"{option!r} is missing at {self.i} in {self.s!r}")

    def program(self, scope: dict):
        out = None
        while True:
            self.space()
            if self.i == len(self.s):
                return out
            if not self.take(";"):
                out = self.expression(scope)
                self.space()
                if self.i < len(self.s) and self.s[self.i] != ";":
                    raise LanguageError(f"{self.s[self.i :]!r} is left over in {self.s!r}")

    def adverbs(self, f: Function) -> Function:
        while self.i < len(self.s) and (got := next((x for x in ADVERBS if self.s.startswith(x, self.i)), None)):
            self.i += len(got)
            f = with_adverb(f, got)
        return f

    def verb(self) -> str | None:
        self.space()
        if self.s.startswith((":[", ":|", ':"')) and self.i == 0:
            return None
        got = self.peek(*VERBS)
        return None if self.peek(":[", ":|") or (got is None) else got

    def expression(self, scope: dict):
        """noun, noun verb expression, or verb expression; right to left."""
        self.space()
        verb = None if NUMBER.match(self.s, self.i) else self.verb()
        if verb:
            self.i += len(verb)
            if any(self.s.startswith(x, self.i) for x in ADVERBS):
                one = self.s.startswith(("'", ":~", "\\~"), self.i) and verb in MONADS
                return self.adverbs(Function(MONADS[verb], 1) if one else Function(DYADS[verb], 2))(self.expression(scope))
            if self.peek(")", ";", "]", "}") or self.i == len(self.s):
                return Function(DYADS[verb], 2)
            if verb not in MONADS:
                raise LanguageError(f"{verb} needs two arguments")
            return MONADS[verb](self.expression(scope))
        start = self.i
        left = self.noun(scope)
        if isinstance(left, Function) and any(self.s.startswith(x, self.i) for x in ADVERBS):
            return self.adverbs(left)(self.expression(scope))
        verb = self.verb()
        if verb == "::":
            name = NAME.match(self.s, start)
            self.i += 2
            scope[name[0]] = self.expression(scope)
            return scope[name[0]]
        if verb:
            self.i += len(verb)
            f = self.adverbs(Function(DYADS[verb], 2)) if any(self.s.startswith(x, self.i) for x in ADVERBS) else DYADS[verb]
            return f(left, self.expression(scope))
        if self.peek("{") or (NAME.match(self.s, self.i) and self.i < len(self.s)):  # a function between its arguments
            f = self.noun(scope)
            return self.adverbs(f)(left, self.expression(scope))
        return left

    def arguments(self, scope: dict) -> list:
        out, empty = [], True
        self.need("(")
        while not self.take(")"):
            if self.take(";"):
                if empty:
                    out.append(None)
                empty = True
                if self.peek(")"):
                    out.append(None)
            else:
                out.append(self.expression(scope))
                empty = False
        return out

    def noun(self, scope: dict):
        self.space()
        s, i = self.s, self.i
        if m := NUMBER.match(s, i):
            self.i = m.end()
            v = float(m[0]) if m[1] or m[2] else int(m[0])
            return Value(F.lit(v).cast("double" if isinstance(v, float) else "long"), 0, "d" if isinstance(v, float) else "i", v)
        if s.startswith("0c", i):
            self.i += 3
            return Value(F.lit(s[i + 2]), 0, "s", s[i + 2])
        if s.startswith('"', i):
            end = i + 1
            while s[end] != '"' or s[end + 1 : end + 2] == '"':
                end += 2 if s[end] == '"' else 1
            self.i = end + 1
            v = s[i + 1 : end].replace('""', '"')
            return Value(F.lit(v), 0, "s", v)
        if self.take(":["):
            return self.choice(scope)
        if self.take("(") is not None:
            out = self.expression(scope)
            self.need(")")
        elif self.take("[;"):
            parts = []
            while not self.take("]"):
                if not self.take(";"):
                    parts.append(self.expression(scope))
            kind = functools.reduce(wider, (p.kind for p in parts))
            out = Value(F.array(*(as_kind(p, kind).col for p in parts)), parts[0].depth + 1, kind)
        elif self.take("["):
            out = listed(self.literals())
        elif self.take("{"):
            out = self.function(scope)
        elif s.startswith(":", i) and (m := NAME.match(s, i + 1)):
            self.i = m.end()
            return Value(F.lit(m[0]), 0, "y", m[0])
        elif m := NAME.match(s, i):
            self.i = m.end()
            if m[0] not in scope and not s.startswith("::", self.i):
                raise LanguageError(f"{m[0]} is not defined")
            out = scope.get(m[0])
        else:
            raise LanguageError(f"{s[i:]!r} can't be read")
        while isinstance(out, Function) and self.i < len(s) and s[self.i] == "(":
            out = out(*self.arguments(scope))
        return out

    def literals(self) -> list:
        out = []
        while not self.take("]"):
            if self.take("["):
                out.append(self.literals())
            else:
                out.append(literal(self.noun({}), "an element of a list"))
        return out

    def choice(self, scope: dict) -> Value:
        parts = [self.expression(scope)]
        while not self.take("]"):
            if not self.take(";", ":|"):
                raise LanguageError("; or ] is missing in a choice")
            parts.append(self.expression(scope))
        if len(parts) % 2 == 0:
            raise LanguageError("a choice needs an otherwise")
        kind = functools.reduce(wider, (p.kind for p in [*parts[1::2], parts[-1]]))
        out = as_kind(parts[-1], kind)
        for c, v in zip(parts[-3::-2], parts[-2::-2], strict=True):
            no = F.size(c.col) == 0 if c.depth else F.length(c.col) == 0 if c.kind == "s" else c.col == 0
            out = Value(F.when(~F.coalesce(no, F.lit(True)), as_kind(v, kind).col).otherwise(out.col), out.depth, kind)
        return out

    def function(self, scope: dict) -> Function:
        start, deep = self.i, 1
        while deep:
            if self.i == len(self.s):
                raise LanguageError("} is missing")
            deep += {"{": 1, "}": -1}.get(self.s[self.i], 0)
            self.i += 1
        body = self.s[start : self.i - 1]
        if m := re.match(r"\s*\[([A-Za-z ]*)\]\s*;", body):  # locals
            body = body[m.end() :]
        used = {x for x in re.findall(r"(?<![A-Za-z0-9.:\"])[xyz](?![A-Za-z0-9.])", re.sub(r'"[^"]*"', '""', body))}
        arity = max(("xyz".index(x) + 1 for x in used), default=0)
        return Function(lambda *args: Parser(body).program(dict(scope) | dict(zip("xyz", args, strict=False))), arity)


def listed(v) -> Value:
    """A literal list."""
    if not isinstance(v, list):
        kind = "d" if isinstance(v, float) else "i" if isinstance(v, int) else "s"
        return Value(F.lit(v).cast({"d": "double", "i": "long", "s": "string"}[kind]), 0, kind, v)
    parts = [listed(x) for x in v]
    if not parts:
        return Value(F.array().cast("array<long>"), 1, "i", [])
    kind = functools.reduce(wider, (p.kind for p in parts))
    depth = max(p.depth for p in parts)
    if any(p.depth != depth for p in parts):
        raise LanguageError("lists of mixed depth have no column type")
    return Value(F.array(*(as_kind(p, kind).col for p in parts)), depth + 1, kind, v)


class Language:
    """A scope of names; `select` adds compiled expressions to a table."""

    def __init__(self, df: DataFrame | None = None):
        self.df, self.scope = df, {}
        for f in df.schema if df is not None else ():
            kind = f.dataType.simpleString()
            inner = kind.replace("array<", "").rstrip(">")
            short = {"string": "s", "bigint": "i", "int": "i", "smallint": "i", "tinyint": "i", "double": "d", "float": "d"}.get(inner)
            if short:
                deep = A.depth(kind)
                to = "array<" * deep + {"s": "string", "i": "bigint", "d": "double"}[short] + ">" * deep
                self.scope[f.name] = Value(F.col(f.name).cast(to), deep, short)

    def define(self, name: str, f: Callable[..., Column], arity: int, kind: str = "d") -> Language:
        """A host function of columns under a name. It gets atoms; a list is gone through element by element."""
        self.scope[name] = Function(lambda *a: atomic1(f, lambda _: kind, a[0]) if arity == 1 else atomic2(f, lambda *_: kind, *a) if arity == 2 else Value(f(*(v.col for v in a)), 0, kind), arity)
        return self

    def load(self, module: str, *names: str, kind: str = "d") -> Language:
        """Functions of columns from a module, all public ones or the named ones, under their own names."""
        found = importlib.import_module(module)
        for n in names or [n for n, f in vars(found).items() if callable(f) and not n.startswith("_") and getattr(f, "__module__", "") == module]:
            f = getattr(found, n)
            self.define(n, f, f.__code__.co_argcount - len(f.__defaults__ or ()), kind)
        return self

    def builtin(self, name: str, arity: int = 1, kind: str = "d") -> Language:
        """A function of Spark SQL by its name."""
        return self.define(name, lambda *a: F.call_function(name, *a), arity, kind)

    def compile(self, source: str) -> Value:
        out = Parser(source).program(self.scope)
        if not isinstance(out, Value):
            raise LanguageError(f"{source!r} has no value")
        return out

    def select(self, keep: str | list[str], name: str, source: str, *renamed: str) -> DataFrame:
        """Columns `keep` and the value of `source` as `name`; "column is x" gives a column a short name."""
        for r in renamed:
            column, _, short = r.partition(" is ")
            self.scope[short] = self.scope[column]
        return self.df.select(*([keep] if isinstance(keep, str) else keep), self.compile(source).col.alias(name))
