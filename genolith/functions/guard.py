"""Read-only SQL: one query over known tables, nothing that writes, reads paths or changes settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Logical operators that only read.
_REFUSED = ("Command", "Insert", "Create", "Drop", "Alter", "Set", "Delete", "Update", "Merge", "Cache", "Load", "Truncate", "Refresh", "Add", "Script", "TableValuedFunction")
_BLOCKED_FUNCTIONS = ("java_method", "reflect", "try_reflect", "input_file_name", "read_files")


#: Statements that tell about tables and plans.
_TELLING = ("ExplainCommand", "DescribeRelation", "ShowTables", "ShowTablesCommand", "ShowColumns")


def _named(plan) -> set[str]:
    """The tables that a describing statement names."""
    return {node.multipartIdentifier().mkString(".").lower() for node in _nodes(plan) if hasattr(node, "multipartIdentifier") and node.getClass().getSimpleName().startswith("Unresolved")}


class Refused(ValueError):
    """A statement that isn't a plain query."""


def _nodes(plan) -> list:
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        found.append(node)
        for group in (node.children(), node.innerChildren(), node.subqueries()):
            todo.extend(group.apply(i) for i in range(group.size()) if hasattr(group.apply(i), "children"))
    return found


def checked(spark: SparkSession, sql: str, tables: set[str]) -> str:
    """The statement, if it is one query over these tables; else Refused."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise Refused(f"not one valid statement: {str(e).splitlines()[0]}") from e
    text = plan.toString()
    names, withs = set(), set()
    told = plan.getClass().getSimpleName()
    if told == "ExplainCommand":
        plan = plan.logicalPlan()
    if told in _TELLING and told != "ExplainCommand":
        known = {t.lower() for t in tables}
        if told in ("DescribeRelation", "ShowColumns") and (unknown := {n for n in _named(plan) if n not in known}):
            raise Refused(f"unknown tables: {', '.join(sorted(unknown))}")
        return sql
    if told.startswith(("Show", "Describe")):
        raise Refused(f"{told} isn't a query")
    for node in _nodes(plan):
        kind = node.getClass().getSimpleName()
        if any(kind.startswith(x) or kind.endswith("Command") or kind == "UnresolvedTableValuedFunction" for x in _REFUSED):
            raise Refused(f"{kind} isn't a query")
        if kind == "UnresolvedWith":
            relations = node.cteRelations()
            for i in range(relations.size()):
                withs.add(relations.apply(i)._1().lower())
        if kind == "UnresolvedRelation":
            parts = node.multipartIdentifier()
            if parts.size() != 1:
                raise Refused("only bare table names are allowed")
            names.add(parts.apply(0).lower())
    lowered = text.lower()
    if any(f"{f}(" in lowered or f"'{f}" in lowered for f in _BLOCKED_FUNCTIONS):
        raise Refused("a function that reads outside the tables")
    if unknown := names - withs - {t.lower() for t in tables}:
        raise Refused(f"unknown tables: {', '.join(sorted(unknown))}")
    return sql


def ask(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The result of a checked query over named DataFrames."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(checked(spark, sql, set(tables)))
