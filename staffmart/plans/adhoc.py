"""Ad-hoc SQL over the five star tables and nothing else."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from staffmart.schema import STAR_TABLES
from staffmart.sources.warehouse import register_star

# Functions that reach out of SQL into the JVM.
REFUSED_FUNCTIONS = ("java_method", "reflect", "try_reflect")

# Leaves of a plan that read nothing: rows written in the statement, ranges, uses of a WITH clause (whose definition is a node too).
HARMLESS_LEAVES = ("OneRowRelation", "LocalRelation", "Range", "CTERelationRef")


class RefusedStatement(ValueError):
    """The statement is not a query over the star."""


def nodes(plan) -> Iterator:
    """All nodes of a resolved plan down to the views it reads: WITH clauses and subqueries included, the insides of views not."""
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        yield node
        if node.getClass().getSimpleName() != "View":
            for found in (node.children(), node.subqueries()):
                waiting += [found.apply(i) for i in range(found.size())]


def sources(plan) -> Iterator[str]:
    """What a resolved plan reads: the name of a view of this session, or the kind of any other leaf."""
    for node in nodes(plan):
        kind = node.getClass().getSimpleName()
        if kind == "View":
            name = node.desc().identifier()
            yield name.table() if name.database().isEmpty() and node.isTempView() else f"view {name.unquotedString()}"
        elif node.children().isEmpty() and kind not in HARMLESS_LEAVES:
            yield kind


def run_sql(spark: SparkSession, statement: str, root: str, as_of: dt.date) -> DataFrame:
    """Run one query over the five views of the current snapshot.

    The statement is placed inside a query, so anything but a query fails to parse. Spark resolves it, and then its plan is looked
    through: wherever a table is read, in a subquery, in a WITH clause or under a name that a WITH clause also uses, it
    must be one of the five views. Nothing runs before that. Paths cannot be read as tables. This guards against
    mistakes and is not a security boundary. An empty result is a result.
    """
    without_text = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"", "''", statement)
    if re.search(rf"(?i)\b({'|'.join(REFUSED_FUNCTIONS)})\s*\(", without_text):
        raise RefusedStatement("function not available in ad-hoc queries")
    session = spark.newSession()
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    register_star(session, root, as_of)
    found = session.sql(f"SELECT * FROM (\n{statement.strip().rstrip(';')}\n)")
    views = {name.lower() for name in STAR_TABLES}
    others = sorted({name for name in sources(found._jdf.queryExecution().analyzed()) if name.lower() not in views})
    if others:
        raise RefusedStatement(f"reads more than the five tables: {others}")
    return found
