"""Read-only SQL: a statement runs only if all that it is made of is known to be a query's.

Three allow-lists decide, and what none of them has is refused: kinds of plan nodes
and expressions as the parser gives them, functions by the groups of Spark's own
registry, and names of tables. The analysed plan is looked at once more, where
whatever is read must stand under one of the allowed views.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection
from threading import Event, Thread

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

#: Rows of a guarded result at most; one more is read to tell that there are more.
HARD_ROWS = 50
TIMEOUT_S = 15.0
#: Plan nodes that the parser makes of a query.
PARSED = frozenset(
    """Aggregate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation
    PipeOperator Pivot Project Sample Sort SubqueryAlias Union Unpivot UnresolvedHaving UnresolvedHint UnresolvedInlineTable
    UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedWith WithWindowDefinition""".split()
)
#: Expressions that the parser makes of SQL's own syntax.
EXPRESSIONS = frozenset(
    """Add AggregateExpression Alias And AnyValue AttributeReference BitwiseAnd BitwiseNot BitwiseOr BitwiseXor CaseWhen Cast Coalesce
    Collate Concat CreateNamedStruct CreateStruct$ Cube CurrentRow$ Divide EqualNullSafe EqualTo Exists First GreaterThan
    GreaterThanOrEqual GroupingSets ILike In InSubquery IntegralDivide IsNotNull IsNull LambdaFunction Last LateralSubquery LessThan
    LessThanOrEqual Like LikeAll LikeAny ListQuery Literal MultiAlias Multiply Not NotLikeAll NotLikeAny Or Overlay RLike Remainder
    Rollup ScalarSubquery ShiftLeft ShiftRight ShiftRightUnsigned SortOrder SpecifiedWindowFrame StringLocate StringTrim StringTrimLeft
    StringTrimRight Substring Subtract TimestampAdd TimestampDiff UnaryMinus UnaryPositive UnboundedFollowing$ UnboundedPreceding$
    UnresolvedAlias UnresolvedAttribute UnresolvedCollation UnresolvedExtractValue UnresolvedFunction UnresolvedGenerator
    UnresolvedNamedLambdaVariable UnresolvedStar UnresolvedStarExceptOrReplace UnresolvedWindowExpression UnspecifiedFrame$
    WindowExpression WindowSpecDefinition""".split()
)
#: Groups of built-in functions whose values follow from their arguments, or from the clock.
GROUPS = frozenset(f"{g}_funcs" for g in "agg array bitwise collection conditional conversion csv datetime generator hash json lambda map math predicate string struct url variant window".split())
#: Functions that may stand in for a table.
TABLE_FUNCTIONS = frozenset("explode explode_outer inline inline_outer json_tuple posexplode posexplode_outer range stack".split())
#: Plan nodes of an analysed query, and those of them that read nothing stored.
ANALYSED = (PARSED | frozenset("CTERelationDef CTERelationRef Expand Range ResolvedHint UnionLoop UnionLoopRef View Window WithCTE".split())) - {n for n in PARSED if n.startswith("Unresolved")}
LEAVES = frozenset("CTERelationRef LocalRelation OneRowRelation Range UnionLoopRef".split())


class SqlRejected(ValueError):
    """The statement isn't a single read-only query."""


def _each(iterable):
    it = iterable.iterator()
    while it.hasNext():
        yield it.next()


def _kind(x) -> str:
    return x.getClass().getSimpleName()


def _nodes(plan):
    """A plan's nodes, those of its named and nested queries included."""
    yield plan
    for part in ("children", "innerChildren"):
        for child in _each(getattr(plan, part)()):
            yield from _nodes(child)


def _expressions(expression):
    yield expression
    for child in _each(expression.children()):
        yield from _expressions(child)


def _require(good: bool, what: str) -> None:
    if not good:
        raise SqlRejected(f"{what} is not allowed")


def _function(spark: SparkSession, parts: list[str]) -> None:
    """A built-in function of an allowed group; one of the session under a built-in's name has no such group."""
    name = ".".join(parts)
    _require(len(parts) == 1, f"the function {name}")
    found = spark._jsparkSession.sessionState().functionRegistry().lookupFunction(spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(parts[0].lower()))
    _require(found.isDefined() and found.get().getGroup() in GROUPS and found.get().getSource() == "built-in", f"the function {name}")


def session_views(spark: SparkSession) -> set[str]:
    return {t.table().lower() for t in _each(spark._jsparkSession.sessionState().catalog().listLocalTempViews("*"))}


def check(spark: SparkSession, sql: str, tables: Collection[str] | None = None) -> None:
    """Raise SqlRejected unless ``sql`` parses to one query over ``tables``: names of temporary views, all of the session's by default.

    Nodes, expressions and functions are judged one by one, so keywords inside
    names and literals don't matter, and a statement's length doesn't either.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise SqlRejected("not a single valid statement") from e
    known = {t.lower() for t in tables} if tables is not None else session_views(spark)
    named, relations = set(), []
    for node in _nodes(plan):
        kind = _kind(node)
        _require(kind in PARSED, kind)
        if kind == "UnresolvedWith":
            named |= {x._1().lower() for x in _each(node.cteRelations())}
        elif kind == "UnresolvedRelation":
            relations.append([*_each(node.multipartIdentifier())])
        elif kind == "UnresolvedTableValuedFunction":
            parts = [*_each(node.name())]
            _require(len(parts) == 1 and parts[0].lower() in TABLE_FUNCTIONS, f"the function {'.'.join(parts)}")
        for expression in _each(node.expressions()):
            for e in _expressions(expression):
                _require(_kind(e) in EXPRESSIONS, _kind(e))
                if _kind(e) == "UnresolvedFunction":
                    _function(spark, [*_each(e.nameParts())])
                elif _kind(e) == "UnresolvedGenerator":
                    _function(spark, [e.name().funcName()])
    for parts in relations:
        # a path that stands for a table, as in text.`/some/file`, has two parts
        _require(len(parts) == 1 and parts[0].lower() in known | named, f"the table {'.'.join(parts)}")


def _read(plan, known: set[str]) -> None:
    """Whatever an analysed plan reads stands under an allowed view; what is below one isn't the statement's."""
    kind = _kind(plan)
    _require(kind in ANALYSED, kind)
    if kind == "View":
        _require(plan.desc().identifier().table().lower() in known, f"the view {plan.desc().identifier().table()}")
        return
    below = [c for part in ("children", "innerChildren") for c in _each(getattr(plan, part)())]
    _require(bool([*_each(plan.children())]) or kind in LEAVES, kind)
    for child in below:
        _read(child, known)


def analysed(spark: SparkSession, sql: str, tables: Collection[str] | None = None) -> DataFrame:
    """``sql`` as a DataFrame, if it passes ``check`` and so does what Spark makes of it."""
    check(spark, sql, tables)
    df = spark.sql(sql)
    known = {t.lower() for t in tables} if tables is not None else session_views(spark)
    _read(df._jdf.queryExecution().analyzed(), known)
    return df


def guarded_select(spark: SparkSession, sql: str, rows: int = 10, tables: Collection[str] | None = None) -> DataFrame:
    """The first rows of a read-only query, lazily: at most HARD_ROWS. Whoever runs it sets the clock; ``run_select`` has its own."""
    return analysed(spark, sql, tables).limit(max(1, min(rows, HARD_ROWS)))


def run_select(spark: SparkSession, sql: str, rows: int = 10, timeout_s: float = TIMEOUT_S, tables: Collection[str] | None = None) -> dict:
    """{columns, rows, truncated} of a read-only query; interrupted after ``timeout_s``."""
    limit = max(1, min(rows, HARD_ROWS))
    df = analysed(spark, sql, tables)
    tag = f"tieout-{uuid.uuid4().hex}"
    context, ended, over = spark.sparkContext, Event(), []

    def watch() -> None:
        # again and again, as a job may begin only after its time is over
        while not ended.wait(0.25 if over else timeout_s):
            over.append(True)
            context.cancelJobsWithTag(tag)

    context.addJobTag(tag)
    context.setInterruptOnCancel(True)
    Thread(target=watch, daemon=True).start()
    try:
        found = df.limit(limit + 1).collect()
    except (PySparkException, Py4JJavaError) as e:
        raise SqlRejected(f"stopped after {timeout_s:g} seconds" if over else str(e).split("\n", 1)[0]) from e
    finally:
        ended.set()
        context.removeJobTag(tag)
        context.setInterruptOnCancel(False)
    return {"columns": df.columns, "rows": [r.asDict(recursive=True) for r in found[:limit]], "truncated": len(found) > limit}
