"""What a query reads, runs and derives its columns from, read off Spark's own plans.

The parsed plan shows statements, relation names and table functions before
anything is looked up; the resolved plan shows the relations behind the names, every
expression, and by its attribute ids the source columns of each output column.
Plans are small: this is driver work that grows with the query text, not with data.
"""

from __future__ import annotations

from collections.abc import Collection, Iterable, Iterator
from typing import NamedTuple

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

# Nodes of queries. Whatever is not listed (commands, inserts, scripts, recursion) is refused.
_BOTH = {
    "Project", "Filter", "Aggregate", "Join", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Intersect",
    "Except", "SubqueryAlias", "Generate", "LateralJoin", "OneRowRelation", "LocalRelation", "Sample", "ResolvedHint",
}
PARSED_NODES = _BOTH | {
    "UnresolvedRelation", "UnresolvedWith", "UnresolvedHaving", "UnresolvedTableValuedFunction", "UnresolvedInlineTable",
    "UnresolvedSubqueryColumnAliases", "UnresolvedTVFAliases", "UnresolvedHint", "WithWindowDefinition", "Pivot", "Unpivot",
}
RESOLVED_NODES = _BOTH | {"View", "WithCTE", "CTERelationDef", "CTERelationRef", "Window", "Expand", "Range", "Deduplicate"}
TABLE_FUNCTIONS = {
    "range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple",
}
# Expressions come from Spark's own packages, except those that run other code or name files.
EXPRESSIONS = "org.apache.spark.sql.catalyst."
REFUSED_EXPRESSIONS = {
    "CallMethodViaReflection", "ScalaUDF", "PythonUDF", "PythonUDAF", "PythonUDTF", "UnresolvedPolymorphicPythonUDTF",
    "ApplyFunctionExpression", "InputFileName", "InputFileBlockStart", "InputFileBlockLength",
}
# Functions that tell how many values there are or in what order, not which.
COUNTING = {
    "Count", "CountIf", "HyperLogLogPlusPlus", "RowNumber", "Rank", "DenseRank", "PercentRank", "CumeDist", "NTile",
}
SUBQUERIES = {"ScalarSubquery", "ListQuery", "Exists", "LateralSubquery"}


class QueryRefused(ValueError):
    """The query does what a governed query must not do."""


def _seq(scala: JavaObject) -> list[JavaObject]:
    return [scala.apply(i) for i in range(scala.size())]


def _kind(node: JavaObject) -> str:
    return node.getClass().getSimpleName().removesuffix("$")


def _nodes(plan: JavaObject) -> Iterator[JavaObject]:
    """All nodes with those of subqueries; a view hides what it is made of."""
    yield plan
    if _kind(plan) != "View":
        for part in (*_seq(plan.children()), *_seq(plan.innerChildren())):
            yield from _nodes(part)


def _tree(expression: JavaObject) -> Iterator[JavaObject]:
    yield expression
    for child in _seq(expression.children()):
        yield from _tree(child)


def check_parsed(spark: SparkSession, sql: str, tables: Collection[str]) -> None:
    """Refuse all but queries over the given tables; nothing is looked up for it."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    nodes = list(_nodes(plan))
    for node in nodes:
        if _kind(node) not in PARSED_NODES:
            raise QueryRefused(f"only queries are allowed, not {_kind(node)}")
    known = {t.lower() for t in tables}
    for node in nodes:
        if _kind(node) == "UnresolvedWith":
            known |= {pair._1().lower() for pair in _seq(node.cteRelations())}
    for node in nodes:
        if _kind(node) == "UnresolvedRelation":
            name = _seq(node.multipartIdentifier())
            if len(name) != 1 or name[0].lower() not in known:
                raise QueryRefused(f"unknown table {'.'.join(name)}")
        elif _kind(node) == "UnresolvedTableValuedFunction":
            name = _seq(node.name())
            if len(name) != 1 or name[0].lower() not in TABLE_FUNCTIONS:
                raise QueryRefused(f"table function {'.'.join(name)} is not allowed")


def check_resolved(result: DataFrame, tables: Collection[str]) -> None:
    """Refuse relations other than the given views and expressions that leave the data."""
    known = {t.lower() for t in tables}
    for node in _nodes(result._jdf.queryExecution().analyzed()):
        if _kind(node) not in RESOLVED_NODES:
            raise QueryRefused(f"{_kind(node)} is not allowed")
        if _kind(node) == "View":
            name = node.desc().identifier()
            if not node.isTempView() or name.database().isDefined() or name.table().lower() not in known:
                raise QueryRefused(f"unknown table {name.unquotedString()}")
            continue
        for expression in _seq(node.expressions()):
            for part in _tree(expression):
                if not part.getClass().getName().startswith(EXPRESSIONS) or _kind(part) in REFUSED_EXPRESSIONS:
                    raise QueryRefused(f"function {part.prettyName()} is not allowed")


class Sources(NamedTuple):
    """The view columns behind a value, and whether it is one of their values unchanged."""

    names: frozenset[str]
    unchanged: bool


NOTHING = Sources(frozenset(), True)


def _together(parts: Iterable[Sources], computed: bool = False) -> Sources:
    parts = list(parts)
    return Sources(frozenset().union(*[p.names for p in parts]), not computed and all(p.unchanged for p in parts))


class _Lineage:
    """Sources by attribute id. Ids are unique over a plan and its subqueries."""

    def __init__(self) -> None:
        self.known: dict[int, Sources] = {}
        self.shared: dict[int, list[Sources]] = {}

    def output(self, plan: JavaObject) -> list[Sources]:
        return [self.known[a.exprId().id()] for a in _seq(plan.output())]

    def of(self, expression: JavaObject) -> Sources:
        kind = _kind(expression)
        if kind == "AttributeReference":
            return self.known[expression.exprId().id()]
        if kind == "OuterReference":
            return self.of(expression.e())
        if kind in COUNTING:
            return NOTHING
        children = _seq(expression.children())
        # a window's partition and order keys are no source of what its function returns
        parts = [self.of(c) for c in (children[:1] if kind == "WindowExpression" else children)]
        if kind in SUBQUERIES:
            self.walk(expression.plan())
            if kind != "Exists":
                parts += self.output(expression.plan())
        return _together(parts, computed=True)

    def walk(self, plan: JavaObject) -> None:
        kind = _kind(plan)
        if kind == "View":
            self.known |= {a.exprId().id(): Sources(frozenset([a.name()]), True) for a in _seq(plan.output())}
            return
        children = _seq(plan.children())
        for child in children:
            self.walk(child)
        if kind == "LateralJoin":
            self.walk(plan.right().plan())
        expressions = _seq(plan.expressions())
        for expression in expressions:
            for part in _tree(expression):
                if _kind(part) == "Alias":
                    self.known[part.exprId().id()] = self.of(part.child())
        if kind == "CTERelationDef":
            self.shared[plan.id()] = self.output(children[0])
        made: list[Sources] | None = None
        if kind == "CTERelationRef":
            made = self.shared[plan.cteId()]
        elif kind in ("Union", "Intersect", "Except"):
            made = [_together(same) for same in zip(*[self.output(c) for c in children])]
        elif kind == "Expand":
            made = [_together(map(self.of, same)) for same in zip(*[_seq(p) for p in _seq(plan.projections())])]
        generated = self.of(plan.generator()) if kind == "Generate" else NOTHING
        for i, attribute in enumerate(_seq(plan.output())):
            key = attribute.exprId().id()
            if made is None:
                self.known.setdefault(key, generated)
            else:
                self.known[key] = _together([made[i], self.known.get(key, NOTHING)])


def source_columns(result: DataFrame) -> list[Sources]:
    """For each output column the names of the view columns it is derived from,
    through aliases, expressions, subqueries, set operations and aggregates, and
    whether it passes them on unchanged. Counts have none; a filter or a sort key
    is no source."""
    plan = result._jdf.queryExecution().analyzed()
    lineage = _Lineage()
    lineage.walk(plan)
    return lineage.output(plan)
