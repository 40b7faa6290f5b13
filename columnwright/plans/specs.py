"""Column suggestions as typed specs: checking them and turning them into columns.

A spec is a dict ``{"name", "op", "input": [columns], "args": {...}}``. Specs are applied
in order; a later one may use an earlier one's column.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from columnwright.functions import binning, rules
from columnwright.functions.missing import finite, float_columns
from columnwright.operators import ranks
from columnwright.operators.joins import BROADCAST_ROWS, lookup_join
from columnwright.operators.knowledge import mapping_frame
from columnwright.operators.ordering import exact_quantiles
from columnwright.storage import store

Spec = Mapping[str, object]


# Names of the library's own columns begin with this.
RESERVED = "__"


class SpecError(ValueError):
    """A spec that cannot be applied; the batch it is in fails as a whole."""


# Functions a column expression may call: each takes values of the row, gives one value, and
# the same one on every attempt.
FUNCTIONS = set(
    """abs acos acosh add_months asin asinh atan atan2 atanh between bin bit_count bround cbrt ceil ceiling char_length
    character_length coalesce concat concat_ws contains conv cos cosh crc32 date_add date_diff date_format date_sub
    datediff day dayofmonth dayofweek dayofyear degrees div e endswith exp expm1 factorial floor format_number greatest
    hash hex hour hypot if ifnull initcap instr isnan isnotnull isnull last_day lcase least left len length levenshtein
    ln locate log log10 log1p log2 lower lpad ltrim md5 minute mod month months_between negative nullif nvl nvl2
    octet_length pi pmod pow power quarter radians regexp_count regexp_extract regexp_like regexp_replace repeat replace
    reverse right rint rlike round rpad rtrim second sha2 shiftleft shiftright sign signum sin sinh size soundex split
    sqrt startswith substr substring tan tanh to_date to_timestamp translate trim trunc try_add try_divide
    try_multiply try_subtract ucase upper weekday weekofyear width_bucket xxhash64 year zeroif nullifzero zeroifnull""".split()
)
# What the parser makes of the rest of an expression that stays within a row.
NODES = set(
    """Literal UnresolvedAttribute UnresolvedFunction Alias Add Subtract Multiply Divide IntegralDivide Remainder
    UnaryMinus UnaryPositive And Or Not EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual
    IsNull IsNotNull IsTrue IsNotTrue IsFalse IsNotFalse IsUnknown IsNotUnknown In Between UnresolvedBetween CaseWhen If
    Cast TryCast Like RLike LikeAll LikeAny BitwiseAnd BitwiseOr BitwiseXor BitwiseNot Substring StringTrim
    StringTrimLeft StringTrimRight Concat Extract""".split()
)
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "avg": F.avg, "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max,
    "std": F.stddev_samp, "count": F.count, "nunique": F.count_distinct,
}
# Aggregates that no sum can give, and the share each stands for; ``quantile`` takes ``p``.
QUANTILES: dict[str, float | None] = {"median": 0.5, "quantile": None}
PLAIN_ARITHMETIC = (
    r"^\s*(?:df\[['\"]\w+['\"]\]\s*=\s*)?"
    r"(?:df\[['\"]\w+['\"]\]|[A-Za-z_]\w*|[0-9.]+|[\s()])+"
    r"(?:[-+*/]+(?:df\[['\"]\w+['\"]\]|[A-Za-z_]\w*|[0-9.]+|[\s()])+)+$"
)


def whole_word(name: str) -> str:
    """Pattern for a name that is not part of a longer identifier."""
    return rf"(?<![A-Za-z0-9_]){re.escape(name)}(?![A-Za-z0-9_])"


def _nodes(sql: str) -> Iterator[tuple[str, list[str]]]:
    """(kind, name parts) of every node of a parsed expression; Spark's own parser reads it."""
    parser = SparkSession.active()._jsparkSession.sessionState().sqlParser()
    stack = [parser.parseExpression(sql)]
    while stack:
        node = stack.pop()
        kind = node.getClass().getSimpleName()
        named = kind in ("UnresolvedAttribute", "UnresolvedFunction")
        yield kind, node.nameParts().mkString("\0").lower().split("\0") if named else []
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]


def sql_expression(sql: str, columns: Iterable[str]) -> Column:
    """A Spark SQL expression over the columns of a row."""
    known = {c.lower() for c in columns}
    try:
        nodes = list(_nodes(sql))
    except Exception as error:
        raise SpecError(f"not a column expression: {sql!r}") from error
    for kind, parts in nodes:
        if kind not in NODES or (kind == "UnresolvedFunction" and parts[-1] not in FUNCTIONS):
            raise SpecError(f"not allowed in a column expression: {'.'.join(parts) or kind}")
        # A name that is no column could be a function without brackets.
        if kind == "UnresolvedAttribute" and parts[0] not in known:
            raise SpecError(f"no column {parts[0]!r}")
    return F.expr(sql)


def from_declarative(spec: Spec) -> Spec:
    """A spec from the ``method`` / ``input_columns`` / ``output_column`` form."""
    method, name = spec["method"], spec["output_column"]
    columns = list(spec["input_columns"])
    if method == "Binning":
        return {"name": name, "op": "bin_fixed_width", "input": columns, "args": {"size": spec["bin_size"]}}
    if method == "Mapping":
        return {"name": name, "op": "mapping", "input": columns, "args": {"mapping": spec["mapping"]}}
    raise SpecError(f"unknown method: {method!r}")


# ---------------------------------------------------------------- checking

def _check_shape(spec: object) -> None:
    """Raise for a suggestion that is no spec at all."""
    texts = lambda x: isinstance(x, (list, tuple)) and all(isinstance(t, str) for t in x)
    if not isinstance(spec, Mapping):
        raise SpecError(f"not a spec: {spec!r}")
    if not all(isinstance(spec.get(part), str) and spec[part] for part in ("name", "op")):
        raise SpecError(f"a spec needs a name and an op: {spec!r}")
    if not texts(spec.get("input") or []) or not isinstance(spec.get("args") or {}, Mapping):
        raise SpecError(f"{spec['name']}: input is a list of columns, args a dict")


def _expressions(args: Mapping[str, object]) -> list[str]:
    rules = [r[0] for r in args.get("rules") or [] if isinstance(r, (list, tuple)) and r]
    found = [args.get("sql"), args.get("condition"), *(args.get("conditions") or []), *rules]
    return [x for x in found if isinstance(x, str)]


def _named(value: object) -> Iterator[str]:
    """Every column named by a ``{"column": name}`` somewhere in the arguments."""
    if isinstance(value, Mapping):
        if isinstance(value.get("column"), str):
            yield value["column"]
        for inner in value.values():
            yield from _named(inner)
    elif isinstance(value, (list, tuple)):
        for inner in value:
            yield from _named(inner)


def columns_used(spec: Spec) -> set[str]:
    """Names that a spec may read, in lower case, as Spark resolves them.

    An expression that cannot be parsed names none; it cannot be applied either.
    """
    args = spec.get("args") or {}
    out = {c.lower() for c in [*(spec.get("input") or []), *(args.get("by") or []), *_named(args)]}
    for sql in _expressions(args):
        try:
            out |= {p for kind, parts in _nodes(sql) if kind == "UnresolvedAttribute" for p in parts}
        except Exception:  # no expression: applying it raises
            continue
    return out


def uses(spec: Spec, name: str) -> bool:
    return name.lower() in columns_used(spec)


def validate(
    specs: Sequence[Spec], existing: Iterable[str], target: str | None = None
) -> tuple[list[Spec], list[tuple[str, str]]]:
    """Specs to apply, and (name, reason) of those skipped: the name is taken or reserved,
    or the target is used. The first of several specs with one name wins; case does not
    tell names apart. Something that is no spec raises ``SpecError``."""
    taken, kept, skipped = {c.lower() for c in existing}, [], []
    for spec in specs:
        _check_shape(spec)
        if target and uses(spec, target):
            skipped.append((spec["name"], "uses_target"))
        elif spec["name"].startswith(RESERVED):
            skipped.append((spec["name"], "reserved"))
        elif spec["name"].lower() in taken:
            skipped.append((spec["name"], "exists"))
        else:
            taken.add(spec["name"].lower())
            kept.append(spec)
    return kept, skipped


def validate_suggestions(
    suggested: DataFrame, existing: Sequence[str], target: str, by: Sequence[str] = ()
) -> DataFrame:
    """Suggestion rows (position, name, generation_method) with a ``status`` and whether
    they are ``plain_arithmetic``.

    Which duplicate comes first is a minimum per name, so a name that many suggestions
    share is combined before it is shuffled.
    """
    uses_target = F.coalesce(F.col("generation_method"), F.lit("")).rlike(whole_word(target))
    marked = suggested.withColumn("uses_target", uses_target).withColumn(
        "exists", F.col("name").isin(list(existing))
    )
    usable = marked.where(~F.col("uses_target") & ~F.col("exists"))
    first = usable.groupBy(*by, "name").agg(F.min("position").alias("__first"))
    joined = lookup_join(marked, store(first, "names").df, [*by, "name"])
    status = (
        F.when(F.col("uses_target"), "uses_target")
        .when(F.col("exists") | (F.col("position") > F.col("__first")), "exists")
        .otherwise("ok")
    )
    return joined.withColumn("status", status).withColumn(
        "plain_arithmetic", F.coalesce(F.col("generation_method"), F.lit("")).rlike(PLAIN_ARITHMETIC)
    ).drop("__first", "uses_target", "exists")


def accumulate(df: DataFrame, rounds: Sequence[Sequence[Spec]]) -> DataFrame:
    """The table with the columns of all rounds, the latest round winning per name.

    Rounds are applied in order, so a spec reads the columns as they were in its own round;
    what an earlier round made of a column keeps its values. Original columns stay.
    """
    original = {c.lower() for c in df.columns}
    for batch in rounds:
        specs = [s for s in batch if s["name"].lower() not in original]
        if specs:
            df = apply_specs(df.drop(*[s["name"] for s in specs]), specs)
    return df


# ---------------------------------------------------------------- applying

def _input(df: DataFrame, spec: Spec, i: int = 0) -> Column:
    name = spec["input"][i]
    if name not in df.columns:
        raise SpecError(f"{spec['name']}: no column {name!r}")
    return finite(F.col(name)) if name in float_columns(df) else F.col(name)


def _existing(df: DataFrame, name: str) -> str:
    """A name that stands for a column of the table just as it is written."""
    if name.lower() not in {c.lower() for c in df.columns}:
        raise SpecError(f"no column {name!r}")
    return name


def _value(df: DataFrame, raw: object) -> Column:
    """A constant, or ``{"column": name}``."""
    return F.col(_existing(df, raw["column"])) if isinstance(raw, Mapping) else F.lit(raw)


def _bin_quantile(df: DataFrame, spec: Spec) -> Column:
    args = spec["args"]
    labels = args["labels"]
    probabilities = args.get("probabilities") or [i / len(labels) for i in range(len(labels) + 1)]
    edges = exact_quantiles(df, spec["input"][0], probabilities)
    if edges[0] is None:
        return F.lit(None).cast("string")
    if len(set(edges)) < len(edges):
        raise SpecError(f"{spec['name']}: quantile edges repeat")
    return binning.bin_edges(_input(df, spec), edges, labels, include_lowest=True)


def _bin_equal_width(df: DataFrame, spec: Spec) -> Column:
    column = _input(df, spec)
    # Extremes of several specs are taken in one pass where that is possible.
    low, high = spec.get("extremes") or df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return F.lit(None).cast("int")
    return binning.bin_equal_width(column, float(low), float(high), spec["args"]["k"])


def _with_extremes(df: DataFrame, specs: Sequence[Spec]) -> list[Spec]:
    """Equal-width specs on columns of the table get their extremes from one pass."""
    wanted = [
        s for s in specs if s["op"] == "bin_equal_width" and s["input"][0] in df.columns
    ]
    if len(wanted) < 2:
        return list(specs)
    row = df.agg(*[
        f(_input(df, s)).alias(f"{a}{i}")
        for i, s in enumerate(wanted) for a, f in (("lo", F.min), ("hi", F.max))
    ]).first()
    found = {id(s): (row[f"lo{i}"], row[f"hi{i}"]) for i, s in enumerate(wanted)}
    return [{**s, "extremes": found[id(s)]} if id(s) in found else s for s in specs]


ROW_OPS: dict[str, Callable[[DataFrame, Spec], Column]] = {
    "bin_edges": lambda df, s: binning.bin_edges(
        _input(df, s), s["args"]["edges"], s["args"]["labels"], s["args"].get("include_lowest", False)
    ),
    "bin_equal_width": _bin_equal_width,
    "bin_quantile": _bin_quantile,
    "bin_fixed_width": lambda df, s: binning.bin_fixed_width(_input(df, s), s["args"]["size"]),
    "case_where": lambda df, s: rules.case_where(
        sql_expression(s["args"]["condition"], df.columns), _value(df, s["args"]["yes"]), _value(df, s["args"]["no"])
    ),
    "flag_conjunction": lambda df, s: rules.flag_conjunction(
        [sql_expression(c, df.columns) for c in s["args"]["conditions"]]
    ),
    "interaction_threshold": lambda df, s: rules.interaction_threshold(
        _input(df, s, 0), s["args"]["threshold"], _input(df, s, 1)
    ),
    "case_rules": lambda df, s: rules.case_rules(
        [(sql_expression(c, df.columns), _value(df, v)) for c, v in s["args"]["rules"]],
        _value(df, s["args"]["otherwise"]) if "otherwise" in s["args"] else None,
    ),
    "expr": lambda df, s: sql_expression(s["args"]["sql"], df.columns),
}
TABLE_OPS: dict[str, Callable[[DataFrame, Spec], DataFrame]] = {
    "pct_rank": lambda df, s: ranks.pct_rank(df, s["input"][0], s["name"]),
    "category_codes": lambda df, s: ranks.category_codes(df, s["input"][0], s["name"]),
    "mapping": lambda df, s: _mapping(df, s),
    "group_transform": lambda df, s: _group_transform(df, s),
}


def _group_transform(df: DataFrame, spec: Spec) -> DataFrame:
    """``agg`` is ``median``, ``quantile`` (with ``p``), or an aggregate that can be combined."""
    args = spec["args"]
    by = [_existing(df, c) for c in args["by"]]
    if args["agg"] in QUANTILES:
        if not isinstance(df.schema[_existing(df, spec["input"][0])].dataType, T.NumericType):
            raise SpecError(f"{spec['name']}: a quantile needs a column of numbers")
        p = QUANTILES[args["agg"]]
        p = args["p"] if p is None else p
        return ranks.group_quantile(df, by, _existing(df, spec["input"][0]), float(p), spec["name"])
    return ranks.group_transform(df, by, AGGREGATES[args["agg"]](_input(df, spec)), spec["name"])


def _mapping(df: DataFrame, spec: Spec) -> DataFrame:
    """A dict has each key once, and its size is known."""
    on, mapping = list(spec["input"]), spec["args"]["mapping"]
    lookup = mapping_frame(df, on, mapping).withColumnRenamed("value", spec["name"])
    return lookup_join(df, lookup, on, small=len(mapping) <= BROADCAST_ROWS)


def apply_specs(df: DataFrame, specs: Sequence[Spec]) -> DataFrame:
    """Append the columns of all specs, or raise ``SpecError`` and append none.

    Row-wise specs that do not use each other become one projection.
    """
    out, pending = df, {}
    try:
        for spec in _with_extremes(df, specs):
            if any(uses(spec, name) for name in pending):
                out, pending = out.withColumns(pending), {}
            op = spec["op"]
            if op in ROW_OPS:
                pending[spec["name"]] = ROW_OPS[op](out, spec)
            elif op in TABLE_OPS:
                out = TABLE_OPS[op](out.withColumns(pending) if pending else out, spec)
                pending = {}
            else:
                raise SpecError(f"unknown operation: {op!r}")
        out = out.withColumns(pending) if pending else out
        out.schema  # resolves every name
    except SpecError:
        raise
    except Exception as error:
        if from_spark(error) and not spec_at_fault(error):
            raise
        raise SpecError(f"specs cannot be applied: {error}") from error
    return out


# How Spark names errors that an expression or the values of a row cause.
ROW_ERROR = re.compile(
    r"(?:Analysis|Parse|Arithmetic|NumberFormat|DateTime|ArrayIndexOutOfBounds|IllegalArgument|Runtime|"
    r"UnsupportedOperation|NoSuchElement)Exception"
)


def from_spark(error: Exception) -> bool:
    return type(error).__module__.startswith(("pyspark.errors", "py4j"))


def spec_at_fault(error: Exception) -> bool:
    """Whether a spec or a value made Spark fail, not a lost executor, a full disk or the like."""
    if isinstance(error, SpecError):
        return True
    if not from_spark(error):
        return False
    named = type(error).__name__
    return bool(ROW_ERROR.fullmatch(named) or re.search(r"Spark" + ROW_ERROR.pattern, str(error)))
