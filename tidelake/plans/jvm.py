"""Walks over Catalyst plans through py4j. All use of Spark's internal API is here."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from tidelake.contract import Target, invalid


def items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def name(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def parsed(spark: SparkSession, sql: str, target: Target = Target.NATIVE):
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as error:
        raise invalid(f"exactly one SQL query is expected: {str(error).splitlines()[0]}", target) from error


def expressions(node) -> Iterator:
    """Every expression of a plan node, outermost first."""
    waiting = items(node.expressions())
    while waiting:
        e = waiting.pop()
        yield e
        waiting += items(e.children())


def _holds_plan(expression) -> bool:
    return name(expression) in {"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"}


def nodes(plan) -> Iterator:
    """Every plan node, with those of subqueries and common table expressions."""
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        yield node
        waiting += items(node.children())
        if name(node) == "UnresolvedWith":
            waiting += [x._2() for x in items(node.cteRelations())]
        waiting += [e.plan() for e in expressions(node) if _holds_plan(e)]


def optimized(df: DataFrame):
    return df._jdf.queryExecution().optimizedPlan()


def scans_run(df: DataFrame) -> list[dict[str, int]]:
    """The metrics of every file scan in the plan that ran, stages of adaptive execution included."""
    found, waiting = [], [df._jdf.queryExecution().executedPlan()]
    while waiting:
        node = waiting.pop()
        kind = name(node)
        if kind == "AdaptiveSparkPlanExec":
            waiting.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            waiting.append(node.plan())
        elif kind == "FileSourceScanExec":
            held = node.metrics()
            found.append({k: held.apply(k).value() for k in ("numFiles", "filesSize", "numOutputRows") if held.contains(k)})
        else:
            waiting += items(node.children())
    return found


def explained(df: DataFrame) -> list[str]:
    return df._jdf.queryExecution().toString().splitlines()


def listing(spark: SparkSession, folder: str) -> dict[str, tuple[str, int]] | None:
    """name -> (full path, size) of a folder's files in any file system; None where there is none."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not store.exists(path):
        return None
    return {s.getPath().getName(): (s.getPath().toString(), s.getLen()) for s in store.listStatus(path) if s.isFile()}


def read_text(spark: SparkSession, file: str) -> str:
    """A small file whole, whatever its name (Spark's readers pass over names that start with an underscore)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    source = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()
