"""Gradients of aggregate losses: a small expression tree with exact derivatives, evaluated as Spark columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Expr:
    """Nodes: ("lit", x), ("col", name), ("par", name), and operators + - * / ^ exp ln neg."""

    op: str
    args: tuple

    def __add__(self, o):
        return Expr("+", (self, expr(o)))

    def __radd__(self, o):
        return expr(o) + self

    def __sub__(self, o):
        return Expr("-", (self, expr(o)))

    def __rsub__(self, o):
        return expr(o) - self

    def __mul__(self, o):
        return Expr("*", (self, expr(o)))

    def __rmul__(self, o):
        return expr(o) * self

    def __truediv__(self, o):
        return Expr("/", (self, expr(o)))

    def __pow__(self, k: float):
        return Expr("^", (self, float(k)))

    def __neg__(self):
        return Expr("neg", (self,))


def expr(x) -> Expr:
    return x if isinstance(x, Expr) else Expr("lit", (float(x),))


def col(name: str) -> Expr:
    return Expr("col", (name,))


def par(name: str) -> Expr:
    return Expr("par", (name,))


def exp(x) -> Expr:
    return Expr("exp", (expr(x),))


def ln(x) -> Expr:
    return Expr("ln", (expr(x),))


def sin(x) -> Expr:
    return Expr("sin", (expr(x),))


def cos(x) -> Expr:
    return Expr("cos", (expr(x),))


def tan(x) -> Expr:
    return Expr("tan", (expr(x),))


def larger(x, y) -> Expr:
    return Expr("max", (expr(x), expr(y)))


def smaller(x, y) -> Expr:
    return Expr("min", (expr(x), expr(y)))


def column(e: Expr, at: dict[str, float]) -> Column:
    a = e.args
    if e.op == "lit":
        return F.lit(a[0])
    if e.op == "col":
        return F.col(a[0]).cast("double")
    if e.op == "par":
        return F.lit(float(at[a[0]]))
    x = column(a[0], at)
    if e.op in ("exp", "ln", "neg", "sin", "cos", "tan"):
        return {"exp": F.exp, "ln": F.ln, "neg": lambda v: -v, "sin": F.sin, "cos": F.cos, "tan": F.tan}[e.op](x)
    if e.op == "^":
        return F.pow(x, F.lit(a[1]))
    y = column(a[1], at)
    if e.op in ("max", "min", "first"):  # first: a where it is the larger (or, negated, the smaller) of a and b, else 0
        return F.greatest(x, y) if e.op == "max" else F.least(x, y) if e.op == "min" else F.when(x > y, 1.0).when(x == y, 0.5).otherwise(0.0)
    return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y}[e.op]()


def derivative(e: Expr, name: str) -> Expr:
    a = e.args
    if e.op in ("lit", "col"):
        return expr(0)
    if e.op == "par":
        return expr(1 if a[0] == name else 0)
    d = derivative(a[0], name)
    if e.op == "neg":
        return -d
    if e.op == "exp":
        return e * d
    if e.op == "ln":
        return d / a[0]
    if e.op == "^":
        return a[1] * a[0] ** (a[1] - 1) * d
    if e.op in ("sin", "cos", "tan"):
        return {"sin": lambda: cos(a[0]) * d, "cos": lambda: -(sin(a[0]) * d), "tan": lambda: d / (cos(a[0]) * cos(a[0]))}[e.op]()
    g = derivative(a[1], name)
    if e.op == "first":
        return expr(0)
    if e.op in ("max", "min"):  # at a tie half of each
        above = Expr("first", (a[0], a[1]) if e.op == "max" else (a[1], a[0]))
        return above * d + (expr(1) - above) * g
    if e.op in "+-":
        return Expr(e.op, (d, g))
    return d * a[1] + a[0] * g if e.op == "*" else (d * a[1] - a[0] * g) / (a[1] * a[1])


def gradient(df: DataFrame, loss: Expr, at: dict[str, float], how: Callable = F.avg) -> DataFrame:
    """One row: the loss and its derivative by each parameter, in one pass."""
    parts = [how(column(loss, at)).alias("loss"), *(how(column(derivative(loss, p), at)).alias(f"d_{p}") for p in at)]
    return df.agg(*parts)


def numeric_gradient(df: DataFrame, loss: Expr, at: dict[str, float], eps: float = 1e-6, how: Callable = F.avg) -> dict[str, float]:
    """Central differences; all shifted losses come from one aggregate."""
    parts = []
    for p, v in at.items():
        parts += [how(column(loss, at | {p: v + eps})).alias(f"{p}+"), how(column(loss, at | {p: v - eps})).alias(f"{p}-")]
    row = df.agg(*parts).first().asDict()
    return {p: (row[f"{p}+"] - row[f"{p}-"]) / (2 * eps) for p in at}


def gradcheck(df: DataFrame, loss: Expr, at: dict[str, float], tolerance: float = 1e-4) -> bool:
    exact, near = gradient(df, loss, at).first(), numeric_gradient(df, loss, at)
    return all(abs(exact[f"d_{p}"] - near[p]) <= tolerance * (1 + abs(near[p])) for p in at)


def jacobian(df: DataFrame, outputs: dict[str, Expr], at: dict[str, float]) -> DataFrame:
    """Each row's derivatives of each output by each parameter."""
    return df.select("*", *(column(derivative(e, p), at).alias(f"d_{o}_{p}") for o, e in outputs.items() for p in at))


def descend(df: DataFrame, loss: Expr, at: dict[str, float], rate: float, steps: int) -> DataFrame:
    """Gradient descent: one aggregate a step over a cached table; returns the path."""
    df = df.cache()
    path = []
    for step in range(steps):
        g = gradient(df, loss, at).first()
        path.append((step, float(g["loss"]), *(float(v) for v in at.values())))
        at = {p: v - rate * g[f"d_{p}"] for p, v in at.items()}
    df.unpersist()
    return df.sparkSession.createDataFrame(path, "step int, loss double, " + ", ".join(f"{p} double" for p in at))
