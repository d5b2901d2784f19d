"""Column access rules and their audit trail."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ColumnDeny:
    """Members of ``roles`` may not select ``columns`` of ``table``."""

    table: str
    columns: tuple[str, ...]
    roles: tuple[str, ...]
    audited: bool = True


class AccessDenied(PermissionError):
    """A role selected a column it may not read."""


# The access rule on the loyalty aggregate.
POLICIES = (ColumnDeny("customer_loyalty", ("name", "lifetime_spend"), ("analyst_readonly",)),)

AUDIT_DDL = "who STRING, role STRING, table_name STRING, column_name STRING, decision STRING, requested_at TIMESTAMP"


def denied_columns(role: str, table: str, policies: Sequence[ColumnDeny] = POLICIES) -> set[str]:
    return {c for p in policies if p.table == table and role in p.roles for c in p.columns}


def governed_view(df: DataFrame, role: str, table: str, policies: Sequence[ColumnDeny] = POLICIES) -> DataFrame:
    """The table as the role sees it; selecting a denied column fails analysis."""
    return df.drop(*denied_columns(role, table, policies))


def decide(requests: DataFrame, policies: Sequence[ColumnDeny] = POLICIES) -> DataFrame:
    """Add ``decision`` to access requests (``role, table_name, column_name``).

    The rules are a handful of constants, so they become one expression instead
    of a join.
    """
    rules: list[Column] = [
        (F.col("table_name") == p.table) & F.col("column_name").isin(*p.columns) & F.col("role").isin(*p.roles)
        for p in policies
    ]
    denied = reduce(lambda a, b: a | b, rules, F.lit(False))
    return requests.withColumn("decision", F.when(denied, "denied").otherwise("allowed"))


class AuditTrail:
    """Decisions of a job, appended to the audit table at once when the block ends, whatever way it ends."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self._path, self._requests = spark, path, []

    def __enter__(self) -> AuditTrail:
        return self

    def __exit__(self, *error: object) -> None:
        self.flush()

    def add(self, who: str, role: str, table: str, columns: Sequence[str], policies: Sequence[ColumnDeny]) -> None:
        now = datetime.datetime.now(datetime.timezone.utc)
        denied = denied_columns(role, table, policies)
        self._requests += [(who, role, table, c, "denied" if c in denied else "allowed", now) for c in columns]

    def flush(self) -> None:
        if self._requests:
            self._spark.createDataFrame(self._requests, AUDIT_DDL).coalesce(1).write.mode("append").parquet(self._path)
            self._requests = []


_MARK = "__governed__"


def governed(df: DataFrame, table: str) -> DataFrame:
    """The table under a name by which queries on it are recognised; columns and rows are the same."""
    return df.alias(_MARK + table)


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _id(expression) -> int:
    return expression.exprId().id()


def _reads(expression) -> set[int]:
    return {_id(a) for a in _items(expression.references().toSeq())}


def _outputs(plan) -> set[int]:
    return {_id(a) for a in _items(plan.output())}


# Operators that hand the columns of their input on and read those that their own expressions name.
_PASSING = {"Filter", "Join", "Sort", "SubqueryAlias", "View", "GlobalLimit", "LocalLimit", "Offset", "Window", "Generate",
            "Repartition", "RepartitionByExpression", "ResolvedHint", "Sample", "Tail"}


def _walk(plan, needed: set[int], mark: str, found: set[str]) -> None:
    """Follow the needed attributes, by expression id, down to the columns of the governed table."""
    kind = plan.nodeName()
    for inner in _items(plan.subqueries()):
        _walk(inner, _outputs(inner), mark, found)
    if kind == "SubqueryAlias" and plan.identifier().name() == mark:
        found.update(a.name() for a in _items(plan.output()) if _id(a) in needed)
        return
    children = _items(plan.children())
    if kind == "Project":
        below = set().union(*(_reads(e) for e in _items(plan.projectList()) if _id(e) in needed))
    elif kind == "Aggregate":
        named = [e for e in _items(plan.aggregateExpressions()) if _id(e) in needed]
        below = set().union(*(_reads(e) for e in [*_items(plan.groupingExpressions()), *named]))
    elif kind == "Union":
        places = [i for i, a in enumerate(_items(plan.output())) if _id(a) in needed]
        for child in children:
            output = _items(child.output())
            _walk(child, {_id(output[i]) for i in places}, mark, found)
        return
    elif kind in _PASSING:
        below = needed.union(*(_reads(e) for e in _items(plan.expressions())))
    else:  # anything else may read all that it is given
        below = set().union(*(_outputs(c) for c in children))
    for child in children:
        _walk(child, below, mark, found)


def columns_read(query: DataFrame, table: str) -> list[str]:
    """The columns of a governed table that a query returns or decides by, whatever they are called in it.

    The analysed plan is followed from its output, and from the conditions, groups, orders and subqueries in it, to the
    attributes of the table. A column that is carried along and dropped again is not read.
    """
    plan, found = query._jdf.queryExecution().analyzed(), set()
    _walk(plan, _outputs(plan), _MARK + table, found)
    return sorted(found)


def read_as(
    query: DataFrame,
    who: str,
    role: str,
    table: str,
    audit: str | AuditTrail | None = None,
    policies: Sequence[ColumnDeny] = POLICIES,
) -> DataFrame:
    """A query over a ``governed`` table on behalf of a role: each column that it reads is recorded with the decision;
    then the query is returned or refused."""
    columns = columns_read(query, table)
    if audit is not None and any(p.audited for p in policies if p.table == table):
        trail = audit if isinstance(audit, AuditTrail) else AuditTrail(query.sparkSession, audit)
        trail.add(who, role, table, columns, policies)
        if trail is not audit:
            trail.flush()
    refused = [c for c in columns if c in denied_columns(role, table, policies)]
    if refused:
        raise AccessDenied(f"role {role} may not read {', '.join(refused)} of {table}")
    return query


def select_as(
    df: DataFrame,
    who: str,
    role: str,
    table: str,
    columns: Sequence[str | Column],
    audit: str | AuditTrail | None = None,
    policies: Sequence[ColumnDeny] = POLICIES,
) -> DataFrame:
    """Select columns or expressions of a table on behalf of a role; see ``read_as``."""
    return read_as(governed(df, table).select(*columns), who, role, table, audit, policies)
