"""What a query may contain, per profile, decided on Spark's own parse tree.

``native`` takes one read-only query whose every source is the open table or a
common table expression. ``session`` also rejects joins, common table
expressions, set operations, named windows and column lists; ``narrow`` also
rejects what doesn't lower to its plan (``plans/lowering.py``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from tidelake.contract import ErrorCode, FallbackReason, QueryError, Target, invalid
from tidelake.plans import jvm
from tidelake.plans.lowering import lowered
from tidelake.plans.sqltext import has_outer_clause, to_spark, tokens

#: Plan nodes that no profile takes, with what they are.
NEVER = {
    "UnresolvedTableValuedFunction": "a table function",
    "UnresolvedInlineTable": "VALUES",
    "Generate": "a generator",
    "LateralJoin": "LATERAL",
    "Sample": "a table sample",
    "UnresolvedHint": "a hint",
    "RelationTimeTravel": "a versioned table; ask for a snapshot version instead",
    "PipeOperator": "a pipe operator",
    "Pivot": "PIVOT",
    "UnresolvedPivot": "PIVOT",
    "Unpivot": "UNPIVOT",
    "UnresolvedUnpivot": "UNPIVOT",
    "ScriptTransformation": "TRANSFORM",
}
SETS = {"Union", "Intersect", "Except", "Distinct.Union"}
QUERY = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "SubqueryAlias", "UnresolvedRelation", "UnresolvedWith",
    "Union", "Intersect", "Except", "Join", "WithWindowDefinition", "UnresolvedHaving", "OneRowRelation", "UnionLoop", "UnresolvedOrdinal", "CTERelationRef", "WithCTE", "View", "UnresolvedSubqueryColumnAliases",
}


@dataclass(frozen=True)
class QueryShape:
    """What a query refers to and does."""

    columns: frozenset[str]
    filter_columns: frozenset[str]
    tables: frozenset[str]
    has_aggregation: bool
    has_order_by: bool
    has_limit: bool
    has_window: bool
    has_join: bool
    has_set_operation: bool
    has_with: bool
    has_subquery: bool
    has_distinct: bool
    has_having: bool


def _attributes(node) -> set[str]:
    return {".".join(jvm.items(e.nameParts())) for e in jvm.expressions(node) if jvm.name(e) == "UnresolvedAttribute"}


def shape(spark: SparkSession, sql: str) -> QueryShape:
    return _shape(list(jvm.nodes(jvm.parsed(spark, to_spark(sql)))))


def _shape(found: list) -> QueryShape:
    names = [jvm.name(n) for n in found]
    expressions = [jvm.name(e) for n in found for e in jvm.expressions(n)]
    calls = {".".join(jvm.items(e.nameParts())).lower() for n in found for e in jvm.expressions(n) if jvm.name(e) == "UnresolvedFunction"}
    aggregates = {"count", "sum", "avg", "min", "max", "array_agg", "collect_list", "bool_and", "bool_or", "every", "any"}
    columns = {c for n in found for c in _attributes(n)}
    filters = {c for n in found if jvm.name(n) == "Filter" for c in _attributes(n)}
    return QueryShape(
        frozenset(columns), frozenset(filters), frozenset(_tables(found)),
        "Aggregate" in names or bool(calls & aggregates), "Sort" in names, "GlobalLimit" in names, any(x.startswith(("WindowExpression", "UnresolvedWindowExpression")) for x in expressions),
        "Join" in names, bool(SETS & set(names)), "UnresolvedWith" in names, bool({"ScalarSubquery", "Exists", "ListQuery"} & set(expressions)), "Distinct" in names, "UnresolvedHaving" in names,
    )


def _tables(found: list) -> set[str]:
    return {".".join(jvm.items(n.multipartIdentifier())) for n in found if jvm.name(n) == "UnresolvedRelation"}


def _needs_native(what: str, target: Target) -> QueryError:
    return QueryError(ErrorCode.FALLBACK_REQUIRED, f"{what} runs on the native target only", target, FallbackReason.NATIVE_REQUIRED)


def check(spark: SparkSession, sql: str, allowed: set[str], target: Target = Target.NATIVE) -> QueryShape:
    """The query's shape, or a QueryError that says what isn't allowed."""
    if not sql.strip():
        raise invalid("the SQL text is empty", target)
    if target is not Target.NATIVE and has_outer_clause(sql, {"FETCH", "QUALIFY"}):
        raise invalid("FETCH and QUALIFY aren't supported", target)
    if "TABLESAMPLE" in {t.upper() for t in tokens(sql)}:  # the parser turns some samples into limits
        raise invalid("a table sample isn't supported", target)
    plan = jvm.parsed(spark, to_spark(sql), target)
    found = list(jvm.nodes(plan))
    known = {x.lower() for x in allowed}
    for node in found:
        kind = jvm.name(node)
        if kind in NEVER:
            raise invalid(f"{NEVER[kind]} isn't supported", target)
        if kind == "UnresolvedWith":
            if node.allowRecursion():
                raise invalid("recursive common table expressions aren't supported", target)
            known |= {x._1().lower() for x in jvm.items(node.cteRelations())}
        if kind not in QUERY:
            raise invalid(f"only read-only queries are supported, not {kind}", target)
    out = _shape(found)
    if strange := sorted(t for t in out.tables if t.lower() not in known):
        raise invalid(f"the query may read {', '.join(sorted(allowed))} only, not {', '.join(strange)}", target)
    if not {t.lower() for t in out.tables} & {x.lower() for x in allowed}:
        raise invalid("the query must read the open table", target)
    if target is not Target.NATIVE:
        for has, what in ((out.has_join, "a join"), (out.has_set_operation, "a set operation")):
            if has:
                raise _needs_native(what, target)
        if any(jvm.name(n) == "WithWindowDefinition" for n in found):
            raise invalid("a named WINDOW clause isn't supported", target)
        if any(jvm.name(n) == "UnresolvedSubqueryColumnAliases" for n in found):
            raise invalid("column lists of sources aren't supported", target)
    if target is Target.SESSION and out.has_with:
        raise _needs_native("a common table expression", target)
    if target is Target.NARROW:
        for has, what in ((out.has_distinct, "DISTINCT"), (out.has_having, "HAVING"), (out.has_window, "a window function"), (out.has_subquery, "a subquery")):
            if has:
                raise _needs_native(what, target)
        if has_outer_clause(sql, {"OFFSET"}):
            raise _needs_native("OFFSET", target)
        for table in allowed:
            lowered(spark, sql, table)
    return out
