"""From the syntax tree to a DataFrame.

Everything becomes DataFrame expressions: pruning, push-down, code generation,
partial aggregation and top-k are Catalyst's.  Names and types are resolved here
because the dialect differs from Spark SQL in precedence, naming and coercion.
"""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import functions as fn
from millrace.ast import Agg, And, Arith, Call, Case, Compare, Expr, In, Item, Like, Num, Pred, Query, Ref, Star, Str, label
from millrace.errors import InvalidArgument, Unsupported
from millrace.profile import Profile
from millrace.types import kind_of

Typed = tuple[Column, T.DataType]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class Scope:
    """Columns that expressions may name, and values already computed for whole expressions."""

    def __init__(self, columns: dict[str, Typed], qualifiers: frozenset[str], done: dict[Expr, Typed] | None = None) -> None:
        self.columns, self.qualifiers, self.done = columns, qualifiers, done or {}

    @classmethod
    def of(cls, df: DataFrame, query: Query) -> Scope:
        names = frozenset(x.lower() for x in (query.table, query.alias) if x)
        columns: dict[str, Typed] = {}
        for field in df.schema.fields:
            columns.setdefault(field.name.lower(), (F.col(_quoted(field.name)), kind_of(field)))
        return cls(columns, names)

    def ref(self, ref: Ref) -> Typed:
        if ref.qualifier is not None and ref.qualifier.lower() not in self.qualifiers:
            raise InvalidArgument(f"unknown qualifier: {ref.qualifier}")
        found = self.columns.get(ref.name.lower())
        if found is None:
            raise InvalidArgument(f"unknown column: {ref.name}")
        return found

    def value(self, expr: Expr) -> Typed:
        if expr in self.done:
            return self.done[expr]
        match expr:
            case Ref():
                return self.ref(expr)
            case Num(text):
                return (F.lit(int(text)).cast("bigint"), T.LongType()) if text.isdigit() and int(text) < 1 << 63 else self._decimal(text)
            case Str(value):
                return F.lit(value), T.StringType()
            case Arith(op, left, right):
                return self._arith(op, left, right)
            case Case(when, then, other):
                return self._case(when, then, other)
            case Call(name, args):
                return self._call(name, args)
            case Agg():
                raise InvalidArgument(f"aggregate not allowed here: {label(expr)}")
            case Star():
                raise InvalidArgument("* is not a value")
        raise TypeError(expr)

    @staticmethod
    def _decimal(text: str) -> Typed:
        digits, _, fraction = text.partition(".")
        kind = T.DecimalType(min(38, max(1, len(digits) + len(fraction))), len(fraction))
        return F.lit(text).cast(kind), kind

    def _arith(self, op: str, left: Expr, right: Expr) -> Typed:
        (a, ka), (b, kb) = self.value(left), self.value(right)
        if not (fn.is_integer(ka) and fn.is_integer(kb)):
            raise InvalidArgument(f"{op} needs integers")
        kind = fn.WIDE if isinstance(ka, T.DecimalType) or isinstance(kb, T.DecimalType) else T.LongType()
        a, b = a.cast(kind), b.cast(kind)
        return (a + b if op == "+" else a - b).cast(kind), kind

    def _case(self, when: Pred, then: Expr, other: Expr) -> Typed:
        (a, kind), b = self.value(then), self.value(other)
        return F.when(self.truth(when), a).otherwise(self.coerced(other, b, kind)[0].cast(kind)), kind

    def _call(self, name: str, args: tuple[Expr, ...]) -> Typed:
        def literal(i: int) -> str:
            if not isinstance(args[i], Str):
                raise InvalidArgument(f"{name} needs a string literal as argument {i + 1}")
            return args[i].value

        if name == "EXTRACT" and len(args) == 2:
            return fn.extract(args[0].name, *self.value(args[1]))
        if name == "DATE_TRUNC" and len(args) == 2:
            return fn.date_trunc(literal(0), *self.value(args[1]))
        if name == "REGEXP_REPLACE" and len(args) == 3:
            return fn.regexp_replace(*self.value(args[0]), literal(1), literal(2))
        if name in fn.SCALARS and len(args) == 1:
            return fn.SCALARS[name]([self.value(args[0])])
        raise Unsupported(f"function {name} with {len(args)} arguments")

    def coerced(self, expr: Expr, typed: Typed, kind: T.DataType) -> Typed:
        """A literal in the type of what it meets; other expressions as they are."""
        sign, literal = 1, expr
        if isinstance(expr, Arith) and expr.op == "-" and expr.left == Num("0") and isinstance(expr.right, Num):
            sign, literal = -1, expr.right
        if isinstance(literal, Num):
            if isinstance(kind, T.BooleanType) and sign == 1 and literal.text in ("0", "1"):
                return F.lit(literal.text == "1"), kind
            if not isinstance(kind, T.NumericType):
                raise InvalidArgument(f"number {literal.text} against {kind.simpleString()}")
            column, own = self.value(literal)
            return (column if sign == 1 else -column), own
        if isinstance(literal, Str):
            return F.lit(self._parsed(literal.value, kind)).cast(kind), kind
        return typed

    @staticmethod
    def _parsed(text: str, kind: T.DataType):
        if isinstance(kind, T.StringType):
            return text
        try:
            if isinstance(kind, T.DateType) and re.fullmatch(r"\d{4}-\d\d-\d\d", text, re.ASCII):
                return datetime.date.fromisoformat(text)
            if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
                if re.fullmatch(r"\d{4}-\d\d-\d\d", text, re.ASCII):
                    text += " 00:00:00"
                if re.fullmatch(r"\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d(\.\d{1,6})?", text, re.ASCII):
                    datetime.datetime.fromisoformat(text)
                    return text
            if isinstance(kind, T.BooleanType) and text.lower() in ("true", "1", "false", "0"):
                return text.lower() in ("true", "1")
            if fn.is_integer(kind) and re.fullmatch(r"-?\d+", text, re.ASCII):
                return int(text)
        except ValueError:
            pass
        raise InvalidArgument(f"{text!r} is no {kind.simpleString()}")

    def _sides(self, left: Expr, right: Expr) -> tuple[Column, Column]:
        a, b = self.value(left), self.value(right)
        literal = (Num, Str)

        def constant(e: Expr) -> bool:
            return isinstance(e, literal) or isinstance(e, Arith) and e.left == Num("0") and isinstance(e.right, Num)

        if constant(right) and not constant(left):
            b = self.coerced(right, b, a[1])
        elif constant(left) and not constant(right):
            a = self.coerced(left, a, b[1])
        ka, kb = a[1], b[1]
        alike = type(ka) is type(kb) or isinstance(ka, T.NumericType) and isinstance(kb, T.NumericType) or fn.is_time(ka) and fn.is_time(kb)
        if not alike:
            raise InvalidArgument(f"{ka.simpleString()} against {kb.simpleString()}")
        return a[0], b[0]

    def truth(self, pred: Pred) -> Column:
        match pred:
            case And(left, right):
                return self.truth(left) & self.truth(right)
            case Compare(op, left, right):
                a, b = self._sides(left, right)
                return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
            case Like(expr, Str(pattern), negated):
                column, kind = self.value(expr)
                if not isinstance(kind, T.StringType):
                    raise InvalidArgument("LIKE needs a string")
                escape = next(chr(c) for c in range(1, 32) if chr(c) not in pattern)
                matched = F.like(column, F.lit(pattern), F.lit(escape))
                return ~matched if negated else matched
            case Like():
                raise Unsupported("LIKE with a pattern that is not a literal")
            case In(expr, values):
                column, kind = self.value(expr)
                return column.isin(*[self.coerced(v, self.value(v), kind)[0] for v in values])
        raise TypeError(pred)


def _aggregates(node: object) -> list[Agg]:
    """Aggregate calls of an expression or predicate, in order."""
    if isinstance(node, Agg):
        return [node]
    if isinstance(node, (Expr, Pred)):
        return [a for f in node.__dataclass_fields__ for a in _aggregates(getattr(node, f))]
    if isinstance(node, tuple):
        return [a for x in node for a in _aggregates(x)]
    return []


class _Linear:
    """Sums of ``c + k``: ``SUM(c) + k * COUNT(c)``, so that all sums of one column share two accumulators."""

    def __init__(self, scope: Scope) -> None:
        self.scope = scope
        self.bases: dict[Expr, tuple[int, T.DataType]] = {}
        self.columns: list[Column] = []

    def text(self, agg: Agg) -> str | None:
        """The sum over the accumulators, None for other aggregates."""
        arg = agg.arg
        if agg.name != "SUM" or not (isinstance(arg, Arith) and isinstance(arg.left, Ref) and isinstance(arg.right, Num) and arg.right.text.isdigit()):
            return None
        shift = int(arg.right.text) * (1 if arg.op == "+" else -1)
        if arg.left not in self.bases:
            self.scope.value(arg)  # raises what the plain sum would
            base, kind = self.scope.value(arg.left)
            n = len(self.bases)
            self.bases[arg.left] = n, kind
            plain = F.coalesce(F.sum(base.cast("bigint")), F.lit(0)) if isinstance(kind, (T.ShortType, T.IntegerType)) else fn.total(base, kind)
            self.columns += [plain.alias(f"b{n}"), F.count(base).alias(f"n{n}")]
        n, kind = self.bases[arg.left]
        if isinstance(kind, (T.ShortType, T.IntegerType)) and abs(shift) < 1 << 31:
            return f"cast(b{n} + n{n} * {shift}L as decimal(38,0))"
        return f"cast(cast(b{n} as decimal(38,0)) + cast(cast('{shift}' as decimal(38,0)) * n{n} as decimal(38,0)) as decimal(38,0))"


def _built(agg: Agg, scope: Scope, whole: bool) -> Column:
    """The aggregate's Column; ``whole`` for a query without groups."""
    if isinstance(agg.arg, Star):
        return F.count(F.lit(1))
    column, kind = scope.value(agg.arg)
    if agg.name == "COUNT":
        return fn.count(column, agg.distinct)
    if agg.name in ("MIN", "MAX"):
        out = F.min(column) if agg.name == "MIN" else F.max(column)
        return F.coalesce(out, F.lit("")) if whole and isinstance(kind, T.StringType) else out
    if not fn.is_summable(kind):
        raise Unsupported(f"{agg.name} of {kind.simpleString()}")
    if agg.name == "AVG":
        return fn.average(column, kind)
    return fn.total(column, kind)


def _kind_of(agg: Agg, scope: Scope) -> T.DataType:
    if agg.name == "COUNT":
        return T.LongType()
    return scope.value(agg.arg)[1] if agg.name in ("MIN", "MAX") else fn.WIDE


def compile_query(query: Query, df: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """The query's result, lazily."""
    scope = Scope.of(df, query)
    if query.where is not None:
        if _aggregates(query.where):
            raise InvalidArgument("aggregate in WHERE")
        df = df.filter(scope.truth(query.where))
    offset = 0 if profile.compat else query.offset
    if query.group or any(_aggregates(i.expr) for i in query.items):
        return _grouped(query, df, scope, offset)
    return _plain(query, df, scope, offset, profile)


def _cut(df: DataFrame, offset: int, limit: int | None) -> DataFrame:
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def _plain(query: Query, df: DataFrame, scope: Scope, offset: int, profile: Profile) -> DataFrame:
    if query.having is not None:
        raise InvalidArgument("HAVING needs groups or aggregates")
    items: list[Item] = []
    for item in query.items:
        if isinstance(item.expr, Star):
            names = df.columns
            if profile.compat and {s.lower() for s in profile.star} <= {n.lower() for n in names}:
                names = [next(n for n in names if n.lower() == s.lower()) for s in profile.star]
            items += [Item(Ref(n)) for n in names]
        else:
            items.append(item)
    names = [i.alias or label(i.expr) for i in items]
    outputs = [scope.value(i.expr) for i in items]
    by_alias = {i.alias.lower(): o for i, o in zip(items, outputs) if i.alias}
    keys = []
    for order in query.order:
        named = by_alias.get(order.expr.name.lower()) if isinstance(order.expr, Ref) and not order.expr.qualifier else None
        keys.append((*(named or scope.value(order.expr)), order))
    hidden = [(label(o.expr), c) for c, _, o in keys if profile.compat and o.expr not in [i.expr for i in items] and label(o.expr).lower() not in {n.lower() for n in names}]
    cells = [c.alias(f"o{i}") for i, (c, _) in enumerate(outputs)] + [c.alias(f"h{i}") for i, (_, c) in enumerate(hidden)]
    sorts = [c.alias(f"s{i}") for i, (c, _, _) in enumerate(keys)]
    out = df.select(*cells, *sorts)
    if keys:
        rest = [F.col(f"o{i}") for i, (_, k) in enumerate(outputs) if not isinstance(k, T.MapType)]
        out = out.orderBy(*[F.desc(f"s{i}") if o.descending else F.asc(f"s{i}") for i, (_, _, o) in enumerate(keys)], *rest)
    out = _cut(out, offset, query.limit)
    shown = [*((f"o{i}", n) for i, n in enumerate(names)), *((f"h{i}", n) for i, (n, _) in enumerate(hidden))]
    return out.select(*[F.col(c).alias(n) for c, n in shown])


def _group_keys(query: Query, scope: Scope) -> list[Expr]:
    """Ordinals first, then aliases, then columns and expressions."""
    aliases = {i.alias.lower(): i.expr for i in query.items if i.alias}
    out = []
    for key in query.group:
        if isinstance(key, Num) and key.text.isdigit() and 1 <= int(key.text) <= len(query.items):
            key = query.items[int(key.text) - 1].expr
        elif isinstance(key, Ref) and key.qualifier is None and key.name.lower() in aliases:
            key = aliases[key.name.lower()]
        if _aggregates(key):
            raise InvalidArgument("a group key cannot be an aggregate")
        if isinstance(key, Star):
            raise InvalidArgument("* is no group key")
        out.append(key)
    return out


def _unqualified(expr: Expr) -> Expr:
    """The same expression for matching: names without qualifier, in lower case."""
    if isinstance(expr, Ref):
        return Ref(expr.name.lower())
    if isinstance(expr, (Expr, Pred)):
        parts = {}
        for f in expr.__dataclass_fields__:
            v = getattr(expr, f)
            parts[f] = _unqualified(v) if isinstance(v, (Expr, Pred)) else tuple(_unqualified(x) for x in v) if isinstance(v, tuple) else v
        return type(expr)(**parts)
    return expr


class _Output(Scope):
    """After grouping: keys and aggregates by structure, then output names."""

    def value(self, expr: Expr) -> Typed:
        found = self.done.get(_unqualified(expr))
        if found is not None:
            return found
        if isinstance(expr, (Star, Agg)):
            raise InvalidArgument(f"not available after grouping: {label(expr)}")
        return super().value(expr)

    def ref(self, ref: Ref) -> Typed:
        try:
            return super().ref(ref)
        except InvalidArgument as e:
            raise InvalidArgument(f"neither grouped nor aggregated: {label(ref)}") from e


def _grouped(query: Query, df: DataFrame, scope: Scope, offset: int) -> DataFrame:
    keys = _group_keys(query, scope)
    if any(isinstance(i.expr, Star) for i in query.items):
        raise InvalidArgument("* in a grouped query")
    wanted = _aggregates((tuple(i.expr for i in query.items), query.having or (), tuple(o.expr for o in query.order)))
    aggs = list({_unqualified(a): a for a in wanted}.values())
    done: dict[Expr, Typed] = {}
    key_columns = []
    for i, key in enumerate(keys):
        column, kind = scope.value(key)
        key_columns.append(column.alias(f"k{i}"))
        done.setdefault(_unqualified(key), (F.col(f"k{i}"), kind))
    linear = _Linear(scope)
    texts = [linear.text(a) for a in aggs]
    built = [_built(a, scope, not keys).alias(f"a{i}") for i, a in enumerate(aggs) if texts[i] is None] + linear.columns
    for i, a in enumerate(aggs):
        done[_unqualified(a)] = (F.col(f"a{i}"), _kind_of(a, scope))
    if keys:
        out = df.groupBy(*key_columns).agg(*built) if built else df.select(*key_columns).distinct()
    else:
        out = df.agg(*built)
    if linear.columns:
        out = out.selectExpr(*[f"k{i}" for i in range(len(keys))], *[f"a{i}" if text is None else f"{text} AS a{i}" for i, text in enumerate(texts)])
    after = _Output({}, scope.qualifiers, done)
    outputs = [after.value(i.expr) for i in query.items]
    for item, typed in zip(query.items, outputs):
        for name in (item.alias, item.expr.name if isinstance(item.expr, Ref) else None):
            if name:
                after.columns.setdefault(name.lower(), typed)
    if query.having is not None:
        out = out.filter(after.truth(query.having))
    sorts = []
    for order in query.order:
        column = after.value(order.expr)[0]
        sorts.append(column.desc() if order.descending else column.asc())
    if keys:
        if not sorts:  # key order is part of the result
            shown = [i for i, item in enumerate(query.items) if not _aggregates(item.expr)]
            sorts = [outputs[i][0].asc() for i in shown]
        sorts += [c.asc() for c, _ in outputs]
        out = out.orderBy(*sorts)
    out = _cut(out, offset, query.limit)
    names = [i.alias or label(i.expr) for i in query.items]
    plain = {_unqualified(k): f"k{i}" for i, k in reversed(list(enumerate(keys)))} | {_unqualified(a): f"a{i}" for i, a in enumerate(aggs)}
    if all(_unqualified(i.expr) in plain for i in query.items):  # one call, however many columns
        return out.selectExpr(*[f"{plain[_unqualified(i.expr)]} AS {_quoted(n)}" for i, n in zip(query.items, names)])
    return out.select(*[c.alias(n) for (c, _), n in zip(outputs, names)])
