"""The read-only guard: Spark's own parser decides what a statement is, and every node of its tree must be one that reads."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession

#: Plan nodes of Spark's parsed trees that only read. Any other node is refused.
READS = frozenset(
    "Aggregate AsOfJoin CTERelationDef DescribeColumn DescribeColumnCommand DescribeFunction DescribeFunctionCommand DescribeNamespace DescribeQueryCommand DescribeRelation DescribeTableCommand Distinct Except ExplainCommand Filter"
    " Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation PipeOperator Pivot Project RelationTimeTravel ResolvedInlineTable Sample ShowColumns ShowColumnsCommand ShowCreateTable ShowFunctions ShowNamespaces"
    " ShowPartitions ShowTableProperties ShowTables ShowTablesCommand ShowViews Sort SubqueryAlias Tail Union Unpivot UnresolvedFunctionName UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedNamespace UnresolvedRelation"
    " UnresolvedSubqueryColumnAliases UnresolvedTVFAliases UnresolvedTable UnresolvedTableOrView UnresolvedTableValuedFunction UnresolvedWith Window WithWindowDefinition CurrentNamespace UnresolvedCurrentNamespace".split()
)
#: Functions that run code of any class, and the clause that computes a function's name.
CODE = ("java_method", "reflect", "try_reflect", "identifier")
#: Table functions that a statement may call; they make rows of their arguments only.
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple variant_explode variant_explode_outer collations sql_keywords".split())


class GuardError(PermissionError):
    """A statement that isn't a plain read."""


def name_of(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def seq(s) -> list:
    """A Scala sequence as a list."""
    return [s.apply(k) for k in range(s.size())]


def children(node) -> Iterator:
    """Children of a plan node, the plans inside its expressions, common table expressions and an explained plan."""
    yield from seq(node.children())
    for inner in seq(node.innerChildren()):
        if hasattr(inner, "children") and "plans.logical" in inner.getClass().getName():
            yield inner
    yield from seq(node.subqueries())
    if name_of(node) == "UnresolvedWith":
        for relation in seq(node.cteRelations()):
            yield relation._2()
    if name_of(node) == "ExplainCommand":
        yield node.logicalPlan()


def walk(node) -> Iterator:
    yield node
    for kid in children(node):
        yield from walk(kid)


def parse(spark: SparkSession, sql: str):
    """The parsed tree; more than one statement, or none, is an error of the parser."""
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise GuardError(f"not one readable statement: {str(e).splitlines()[0][:200]}") from e


def _calls(e) -> Iterator[str]:
    """The last part of the name of each function that an expression calls; ``identifier`` where a name is computed."""
    if name_of(e) == "UnresolvedFunction":
        yield str(seq(e.nameParts())[-1]).lower()
    if name_of(e) == "ExpressionWithUnresolvedIdentifier":
        yield "identifier"
    for kid in seq(e.children()):
        yield from _calls(kid)


def _window_calls(node) -> Iterator[str]:
    """Calls in the definitions of a WINDOW clause, which aren't among a node's expressions."""
    values = node.windowDefinitions().values().toSeq()
    for e in seq(values):
        yield from _calls(e)


def check_read_only(spark: SparkSession, sql: str):
    """The parsed tree of a statement that only reads; GuardError for any other.

    Functions that call code of any class are refused wherever they stand; their names can't be written in another way, so
    the expressions are walked only where a name occurs in the text.
    """
    plan = parse(spark, sql)
    suspect = any(name in sql.lower() for name in CODE)
    for node in walk(plan):
        name = name_of(node)
        if name not in READS:
            raise GuardError(f"{name} isn't allowed: statements must read only")
        if name == "UnresolvedTableValuedFunction" and (called := str(seq(node.name())[-1]).lower()) not in TABLE_FUNCTIONS:
            raise GuardError(f"table function {called} isn't allowed")
        if suspect:
            called = {c for e in seq(node.expressions()) for c in _calls(e)}
            called |= set(_window_calls(node)) if name == "WithWindowDefinition" else set()
            if found := called & set(CODE):
                raise GuardError(f"{min(found)} isn't allowed: it can run any code")
    return plan


def relations(node, scope: frozenset[str] = frozenset(), aliased: bool = False) -> Iterator[tuple]:
    """(node, parts of the name, whether an alias is right above) of each table named in a parsed tree; CTE names in scope aren't tables."""
    name = name_of(node)
    if name == "UnresolvedRelation":
        parts = [str(p) for p in seq(node.multipartIdentifier())]
        if len(parts) > 1 or parts[0].lower() not in scope:
            yield node, parts, aliased
        return
    if name == "UnresolvedWith":
        for relation in seq(node.cteRelations()):
            own = str(relation._1()).lower()
            yield from relations(relation._2().child(), scope | {own} if node.allowRecursion() else scope)
            scope = scope | {own}
        yield from relations(node.child(), scope)
        return
    for kid in children(node):
        yield from relations(kid, scope, name == "SubqueryAlias")


def explained(plan) -> bool:
    return name_of(plan) == "ExplainCommand"


def has_limit(plan) -> bool:
    """Whether the outermost query limits its rows."""
    while name_of(plan) in ("UnresolvedWith", "Sort", "Offset", "GlobalLimit", "LocalLimit", "SubqueryAlias", "UnresolvedOrdinal"):
        if name_of(plan) in ("GlobalLimit", "LocalLimit"):
            return True
        plan = plan.children().apply(0)
    return False
