"""A gate for read-only SQL, in two steps before anything runs.

The parsed plan shows what kind of statement it is: every node must be on a list, and every function a built-in one of the groups that
compute (a session's own functions, whatever names they took, are none). The analysed plan shows what it reads: there the
names of aliases and common table expressions are resolved, each leaf is a relation, and a leaf must be a value made by the
query itself or lie within a view that was named as readable.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

#: Plan nodes of queries (fixed values).
ALLOWED = frozenset("""
Project Filter Aggregate UnresolvedRelation SubqueryAlias UnresolvedSubqueryColumnAliases Join LateralJoin AsOfJoin Sort GlobalLimit LocalLimit LimitAll Offset Tail Distinct Union
Intersect Except UnresolvedWith UnresolvedInlineTable LocalRelation OneRowRelation UnresolvedHaving Window WithWindowDefinition Generate Pivot Unpivot Expand Sample
UnresolvedHint UnresolvedTableValuedFunction Range UnresolvedOrdinal Repartition RepartitionByExpression Deduplicate UnresolvedPivot TransposeUnpivot SetOperation
""".split())
#: Groups of built-in functions that compute from their arguments alone (fixed values); those of no such group are refused.
FUNCTION_GROUPS = frozenset("""
agg array bitwise collection conditional conversion csv datetime generator hash json lambda map math predicate string struct url variant window
""".split())
FUNCTIONS = frozenset(["typeof"])
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer json_tuple stack".split())
#: Leaves of an analysed plan that read nothing.
VALUES = frozenset("OneRowRelation LocalRelation Range CTERelationRef UnionLoopRef".split())
#: Expressions that run code of the session's.
FOREIGN = frozenset("ScalaUDF PythonUDF PythonUDAF PythonFuncExpression ScalaAggregator ScalaUDAF HiveSimpleUDF HiveGenericUDF HiveUDAFFunction CallMethodViaReflection TryReflect UserDefinedPythonFunction".split())
PATH_SOURCES = frozenset("parquet csv json text orc avro binaryfile delta jdbc xml file".split())


class Rejected(ValueError):
    pass


def _seq(s) -> Iterator:
    it = s.iterator()
    while it.hasNext():
        yield it.next()


def _nodes(plan) -> Iterator:
    """The plan's nodes, with those of common table expressions and subqueries."""
    stack = [plan]
    while stack:
        p = stack.pop()
        yield p
        stack += _seq(p.children())
        name = p.getClass().getSimpleName()
        stack += [x for x in _seq(p.innerChildren()) if hasattr(x, "children") and _is_plan(x)]
        if name in ("ExplainCommand",):
            stack.append(p.logicalPlan())
        for e in _expressions(p):
            if "Subquery" in e.getClass().getSimpleName() or e.getClass().getSimpleName() in ("Exists", "ListQuery", "InSubquery"):
                stack += [x for x in [getattr(e, "plan", None) and e.plan()] if x is not None and not isinstance(x, str)] if e.getClass().getSimpleName() != "InSubquery" else []


def _is_plan(x) -> bool:
    return "LogicalPlan" in {c for c in _bases(x.getClass())}


def _bases(cls) -> Iterator[str]:
    while cls is not None:
        yield cls.getSimpleName()
        cls = cls.getSuperclass()


def _expressions(plan) -> Iterator:
    stack = list(_seq(plan.expressions()))
    while stack:
        e = stack.pop()
        yield e
        stack += _seq(e.children())


def _function_allowed(spark: SparkSession, parts: list[str]) -> bool:
    """Whether the name stands for a built-in function of an allowed group in this session."""
    if len(parts) != 1:
        return False
    found = spark._jsparkSession.sessionState().functionRegistry().lookupFunction(spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(parts[0].lower()))
    if found.isEmpty() or found.get().getSource() != "built-in":
        return False
    return found.get().getGroup().removesuffix("_funcs") in FUNCTION_GROUPS or parts[0].lower() in FUNCTIONS


def _parsed(spark: SparkSession, sql: str):
    """The parsed query (what EXPLAIN holds, if it is one), of allowed nodes and functions alone."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        raise Rejected(f"not one SQL query: {e.getCondition() if hasattr(e, 'getCondition') else e}") from None
    if plan.getClass().getSimpleName() == "ExplainCommand":
        plan = plan.logicalPlan()
    for node in _nodes(plan):
        name = node.getClass().getSimpleName()
        if name not in ALLOWED:
            raise Rejected(f"{name} is not allowed in read-only SQL")
        if name == "UnresolvedRelation":
            r = [str(x) for x in _seq(node.multipartIdentifier())]
            if len(r) > 1 and r[0].lower() in PATH_SOURCES:
                raise Rejected("files can't be read by path")
        if name == "UnresolvedTableValuedFunction":
            f = [str(x) for x in _seq(node.name())]
            if len(f) != 1 or f[0].lower() not in TABLE_FUNCTIONS:
                raise Rejected(f"table function {'.'.join(f)} is not allowed")
        for e in _expressions(node):
            if e.getClass().getSimpleName() == "UnresolvedFunction":
                f = [str(x) for x in _seq(e.nameParts())]
                if not _function_allowed(spark, f):
                    raise Rejected(f"function {'.'.join(f)} is not allowed")
    return plan


def _relations(plan) -> Iterator:
    """Leaves and views of an analysed plan, those of subqueries included; what a view holds is its own affair."""
    stack = [plan]
    while stack:
        p = stack.pop()
        name = p.getClass().getSimpleName()
        below = list(_seq(p.children()))
        if name == "View" or not below:
            yield name, p
        if name == "View":
            continue
        stack += below
        for e in _expressions(p):
            kind = e.getClass().getSimpleName()
            if kind in FOREIGN:
                raise Rejected("functions of the session are not allowed")
            if "PlanExpression" in set(_bases(e.getClass())):
                stack.append(e.plan())


def _analysed(spark: SparkSession, plan):
    state = spark._jsparkSession.sessionState()
    try:
        return state.executePlan(plan, getattr(state, "executePlan$default$2")()).analyzed()
    except AnalysisException as e:
        if (e.getCondition() or "").startswith(("TABLE_OR_VIEW_NOT_FOUND", "UNRESOLVED_ROUTINE", "UNRESOLVABLE_TABLE_VALUED_FUNCTION")):
            raise Rejected(f"unknown table or function: {e.getCondition()}") from None
        raise


def check(spark: SparkSession, sql: str, tables: set[str] | None = None) -> None:
    """Raises Rejected unless sql is one read-only query over temporary views (those in `tables`, if given). EXPLAIN of such a query
    passes. A query that is none for another reason, such as an unknown column, raises the analyser's own error."""
    allowed = None if tables is None else {t.lower() for t in tables}
    for kind, p in _relations(_analysed(spark, _parsed(spark, sql))):
        if kind != "View":
            if kind not in VALUES:
                raise Rejected(f"{kind} reads something that is no registered view")
            continue
        name = p.desc().identifier()
        if not p.isTempView() or name.database().isDefined() or (allowed is not None and name.table().lower() not in allowed):
            raise Rejected(f"unknown table {name.unquotedString()}")


def execute(spark: SparkSession, sql: str, tables: set[str] | None = None) -> DataFrame:
    """Run checked SQL over registered views."""
    check(spark, sql, tables)
    return spark.sql(sql)
