"""Read-only ad-hoc SQL, the catalog behind it, and table previews."""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C

_LEADING = re.compile(r"\A(?:\s+|--[^\n]*(?:\n|\Z)|/\*.*?(?:\*/|\Z))*", re.DOTALL)
#: The same in the column functions' dialect, where blanks have to be named and groups may give nothing back.
_LEADING_TEXT = r"(?s)\A(?:[\s\x0B\x1C-\x1F\x85\p{Z}]+|--[^\n]*(?:\n|\z)|/\*.*?(?:\*/|\z))*+"
# Nodes that an analysed query may consist of. Whatever is not listed (commands, writes, script
# transforms, Python and streaming operators) is refused.
_READING_NODES = frozenset(
    """
    Aggregate AsOfJoin CTERelationDef CTERelationRef DataSourceV2Relation DataSourceV2ScanRelation Deduplicate
    Distinct EmptyRelation Except Expand Filter Generate GlobalLimit HiveTableRelation Intersect Join LateralJoin
    LocalLimit LocalRelation LogicalRDD LogicalRelation OneRowRelation Offset Pivot Project Range RebalancePartitions
    Repartition RepartitionByExpression ResolvedHint ResolvedInlineTable Sample Sort SubqueryAlias Tail Union Unpivot
    View Window WithCTE
    """.split()
)
# Expressions that run code from outside the engine.
_FOREIGN_CODE = re.compile(r"Reflect|Python|ScalaUD|Hive|ApplyFunctionExpression|V2Aggregator|UserDefined|TypedAgg")


@dataclass
class QueryResult:
    columns: list[str] = field(default_factory=list)
    rows: list[list[Any]] = field(default_factory=list)
    row_count: int = 0
    duration_ms: int = 0
    truncated: bool = False
    error: str | None = None


def _statements(text: str) -> list[str]:
    return [part for part in text.split(";") if part.strip()]


def sql_guard(text: str) -> str | None:
    """Reason to refuse a text before it is parsed, or None.

    The split at ``;`` is naive on purpose: one inside a string literal is refused as well.
    """
    if not text.strip():
        return C.SQL_EMPTY
    if not _LEADING.sub("", text, count=1).lower().startswith(("select", "with")):
        return C.SQL_NOT_SELECT
    if len(_statements(text)) > 1:
        return C.SQL_MANY_STATEMENTS
    return None


def guard_reason(text: Column | str) -> Column:
    """``sql_guard`` over a column of texts, null where a text may be parsed; a null text is an empty one."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    blank = r"^[\s\x0B\x1C-\x1F\x85\p{Z}]*$"
    start = F.lower(F.regexp_replace(text, _LEADING_TEXT, ""))
    statements = F.filter(F.split(text, ";"), lambda part: ~part.rlike(blank))
    return (
        F.when(text.rlike(blank), C.SQL_EMPTY)
        .when(~(start.startswith("select") | start.startswith("with")), C.SQL_NOT_SELECT)
        .when(F.size(statements) > 1, C.SQL_MANY_STATEMENTS)
    )


def _each(sequence) -> Iterator:
    return (sequence.apply(i) for i in range(sequence.size()))


def _refusal(plan) -> str | None:
    """What makes an analysed plan more than a query, looking into subqueries as well."""
    plans, expressions = [plan], []
    while plans:
        node = plans.pop()
        name = node.getClass().getSimpleName()
        if name not in _READING_NODES:
            return name
        plans += _each(node.children())
        plans += _each(node.subqueries())
        expressions += _each(node.expressions())
    while expressions:
        expression = expressions.pop()
        name = expression.getClass().getSimpleName()
        if _FOREIGN_CODE.search(name):
            return name
        expressions += _each(expression.children())
    return None


def read_only(spark: SparkSession, text: str) -> DataFrame:
    """The query as a DataFrame; raises ValueError unless it can only read.

    Nothing runs before the decision. The text is analysed between parentheses, where the grammar
    admits no command and no write, and without file paths as tables; every node and expression of
    the analysed plan must then be one that reads.
    """
    if reason := sql_guard(text):
        raise ValueError(reason)
    statement = _statements(text)[0]
    setting = "spark.sql.runSQLOnFiles"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        enclosed = spark.sql(f"SELECT * FROM (\n{statement}\n)")
        if _refusal(enclosed._jdf.queryExecution().analyzed()):
            raise ValueError(C.SQL_NOT_SELECT)
        return spark.sql(statement)
    finally:
        spark.conf.set(setting, before)


def run_sql(
    spark: SparkSession,
    text: str,
    max_rows: int = C.SQL_MAX_ROWS,
    timeout_s: float = C.SQL_TIMEOUT_SECONDS,
) -> QueryResult:
    """Run one read-only query. Failures are part of the result, never raised.

    At most ``max_rows + 1`` rows reach the driver; jobs still running at the timeout are cancelled.
    """
    started = time.monotonic()
    context = spark.sparkContext
    tag = f"adhoc-{uuid.uuid4().hex}"
    expired = threading.Event()

    def expire() -> None:
        expired.set()
        context.cancelJobsWithTag(tag)

    result = QueryResult()
    timer = threading.Timer(timeout_s, expire)
    timer.daemon = True
    context.addJobTag(tag)
    timer.start()
    try:
        frame = read_only(spark, text)
        rows = frame.limit(max_rows + 1).collect()
        result.columns = frame.columns
        result.truncated = len(rows) > max_rows
        result.rows = [list(row) for row in rows[:max_rows]]
        result.row_count = len(result.rows)
    except Exception as problem:
        result.error = f"query timed out after {timeout_s:g}s" if expired.is_set() else str(problem)
    finally:
        timer.cancel()
        context.removeJobTag(tag)
    result.duration_ms = int((time.monotonic() - started) * 1000)
    return result


def catalog(spark: SparkSession, databases: list[str], hidden: tuple[str, ...] = ()) -> DataFrame:
    """Columns of every table in the databases that exist; ``hidden`` names ``database.table``."""
    rows = []
    for database in sorted(databases):
        if not spark.catalog.databaseExists(database):
            continue
        for found in spark.catalog.listTables(database):
            if found.isTemporary or f"{database}.{found.name}" in hidden:
                continue
            columns = spark.catalog.listColumns(f"`{database}`.`{found.name}`")
            rows += [(database, found.name, n, c.name, c.dataType) for n, c in enumerate(columns, 1)]
    layout = "table_schema string, table_name string, position int, column_name string, data_type string"
    return spark.createDataFrame(rows, layout).orderBy("table_schema", "table_name", "position")


@dataclass
class TablePreview:
    row_count: int | None
    row_count_error: str | None
    sample: QueryResult | None
    sample_error: str | None


def _quoted(*names: str) -> str:
    return ".".join("`" + name.replace("`", "``") + "`" for name in names)


def table_preview(spark: SparkSession, database: str, table: str) -> TablePreview:
    """Row count and a few rows; each may fail without the other."""
    name = _quoted(database, table)
    counted = run_sql(spark, f"SELECT COUNT(*) FROM {name}")
    sample = run_sql(spark, f"SELECT * FROM {name} LIMIT {C.PREVIEW_ROWS}")
    return TablePreview(
        row_count=None if counted.error else counted.rows[0][0],
        row_count_error=counted.error,
        sample=None if sample.error else sample,
        sample_error=sample.error,
    )
