"""The user's view: runs that load and capture tables, checks, verdicts, search.

A :class:`Workspace` is a root folder; a :class:`Run` is one execution of a
script within a scope.  Runs of one script share a scope, different scripts do
not.  Everything a run registers is written before the call returns, so a run
can be picked up again by its id from any driver.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustweave import schema
from trustweave.functions.scalar import confidence_string
from trustweave.operators import lineage, search, trust
from trustweave.plans.check import captured, check_run, check_runs
from trustweave.session import durable, empty, shared_path
from trustweave.sources import delimited
from trustweave.sources.tables import CAPTURE_RUN, RUN_ID, Tables, check_run_id

LOAD_PREFIX = "LOADER_"
LISTED_SCOPES = 1000
#: Tables of so few scopes are written without being rebalanced by scope.
FEW_SCOPES = 4


class OrderViolation(ValueError):
    """A variable was registered before one of its sources."""


class RunFinished(ValueError):
    """A finished run takes no more loads, captures or finishes."""


class Workspace:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.tables = Tables(spark, root or shared_path(spark, "workspace"))

    # -- runs -------------------------------------------------------------

    def start_run(self, scope: str, info: str = "", run_id: str | None = None) -> Run:
        """Register a new run and give it an id."""
        run_id = run_id or str(uuid.uuid4())
        check_run_id(run_id)
        self._run_event(scope, run_id, info, "start")
        return Run(self, scope, run_id)

    def run(self, scope: str, run_id: str) -> Run:
        """An existing run with the variables it has registered so far."""
        if self.tables.read("runs", scope=scope).where(F.col("run_id") == run_id).isEmpty():
            raise KeyError(f"unknown run {run_id!r} in scope {scope!r}")
        return Run(self, scope, run_id)

    def start_runs(self, runs: DataFrame) -> None:
        """Register many runs (``scope, run_id, info, at``) in one write."""
        self._refuse_bad_ids(runs, "run_id")
        self.tables.write("runs", runs.withColumn("event", F.lit("start")))

    def register(self, requests: DataFrame) -> DataFrame:
        """Register many operations in one write; returns what was registered.

        ``requests`` has the columns of the operation log without indices.  The
        first registration of a variable in a run stays, also across batches, and
        sources may stem from an earlier batch.  ``op_seq`` orders a batch; what is
        stored comes before it.  An unknown or finished run, a variable that names
        itself, or a source that is not registered before refuses them all.
        Only the folders of the batch's scopes are read, and ``requests`` is computed once.
        """
        first = lineage.first_registrations(requests)
        scopes = self._scopes(first)
        batch = first.select(*lineage.RUN).distinct()
        stored = self._within(self.tables.read("operations"), scopes).join(batch, lineage.RUN, "left_semi").select(*lineage.RUN, "dst_var", "dst_idx")
        running = search.current_runs(self._within(self.tables.read("runs"), scopes)).where("finish IS NULL")
        registered = durable(lineage.resolve_registrations(first, stored), "registered")
        bad = None
        # a source that was not registered before has no index, and an unknown run none that runs: else all is well
        if not registered.where("exists(src_idxs, x -> x IS NULL)").isEmpty() or not registered.select(*lineage.RUN).distinct().join(
                running.select(*lineage.RUN), lineage.RUN, "left_anti").isEmpty():
            bad = lineage.validate_order(registered, running, stored).orderBy("violation", "op_seq").first()
        if bad and bad["violation"] == "unknown_run":
            raise KeyError(f"run {bad['run_id']!r} in scope {bad['scope']!r} is not running")
        if bad:
            raise OrderViolation(f"{bad['dst_var']!r} of run {bad['run_id']!r}: source {bad['src_var']!r} ({bad['violation']})")
        self.tables.write("operations", registered, dealt=_few(scopes))
        return registered

    def _scopes(self, rows: DataFrame) -> list[str] | None:
        """The scopes of some rows, or none if there are too many to name."""
        scopes = [r["scope"] for r in rows.select("scope").distinct().limit(LISTED_SCOPES + 1).collect()]
        return scopes if len(scopes) <= LISTED_SCOPES else None

    def _within(self, table: DataFrame, scopes: list[str] | None) -> DataFrame:
        """Only the folders of some scopes."""
        return table if scopes is None else table.where(F.col("scope").isin(scopes))

    def finish_runs(self, runs: DataFrame, check: bool = False, compat: bool = False) -> DataFrame | None:
        """Stamp the finish of many runs (``scope, run_id, at``) in one write; with ``check``, test them too.

        A run that was not started, or is finished already, refuses them all.
        The checks are one job a scope, see :meth:`check_runs`.
        """
        current = self.runs_view().where("finish IS NULL")
        bad = runs.join(current, lineage.RUN, "left_anti").first()
        if bad:
            raise RunFinished(f"run {bad['run_id']!r} in scope {bad['scope']!r} is not running")
        self.tables.write("runs", runs.withColumns({"info": F.lit(None).cast("string"), "event": F.lit("finish")}))
        if not check:
            return None
        scopes = sorted(r["scope"] for r in runs.select("scope").distinct().collect())
        checked = [self.check_runs(s, runs.where(F.col("scope") == s), compat) for s in scopes]
        return reduce(DataFrame.unionByName, checked) if checked else empty(self.spark, schema.CONFIDENCE)

    def compact(self) -> None:
        """Put the many small files of single events together; nobody may write meanwhile."""
        for name in ("runs", "operations", "scores", "loads", "growths"):
            self.tables.compact(name)

    def _refuse_bad_ids(self, df: DataFrame, column: str) -> None:
        good = F.coalesce(F.col(column).cast("string").rlike(f"^{RUN_ID}$"), F.lit(False))
        bad = df.where(~good).select(column).first()
        if bad:
            check_run_id(bad[0])

    def _run_event(self, scope: str, run_id: str, info: str | None, event: str) -> None:
        self.tables.write_row("runs", one_row(self.spark, schema.RUNS, {
            "scope": scope, "run_id": run_id, "info": info, "event": event, "at": F.current_timestamp(),
        }))

    def import_history(
        self,
        scope: str,
        var: str,
        df: DataFrame,
        run_id: str,
        started: Column,
        inspected: Sequence[str | int] = (),
        operation: str = "IMPORT",
    ) -> None:
        """Take a table with one or more finished runs in it as captures of ``var``.

        ``run_id`` names the column that tells the runs apart, ``started`` is an
        aggregate giving each run's start.  Runs may get several variables one by
        one; one that has ``var`` already refuses them all.
        """
        self._refuse_bad_ids(df, run_id)
        data = df.drop(run_id)
        columns, kinds = inspect_columns(data, inspected), column_classes(data)
        runs = durable(df.groupBy(F.col(run_id).cast("string").alias("run_id")).agg(started.cast("timestamp").alias("at")), "imported")
        has = self.tables.read("operations", scope=scope).where(F.col("dst_var") == var)
        again = runs.join(has, "run_id", "left_semi").first()
        if again:
            raise ValueError(f"run {again['run_id']!r} in scope {scope!r} has '{var}' already")
        new = durable(runs.join(self.tables.read("runs", scope=scope), "run_id", "left_anti"), "new-runs")
        self.tables.write_captures(df.select(*[f"`{c}`" for c in data.columns], run_id), scope, var, run_id)
        events = F.explode(F.array(F.lit("start"), F.lit("finish")))
        self.tables.write("runs", new.select(
            F.lit(scope).alias("scope"), "run_id", F.lit("").alias("info"), events.alias("event"), "at"))
        base = self.tables.capture_path(scope, var)
        self.tables.write("operations", runs.select(
            F.lit(scope).alias("scope"), "run_id", F.lit(1).cast("long").alias("op_seq"),
            F.array().cast("array<string>").alias("src_vars"),
            F.array().cast("array<string>").alias("src_idxs"),
            F.lit(operation).alias("operation"), F.lit(var).alias("dst_var"),
            lineage.operation_index(F.lit(scope), F.col("run_id"), F.lit(var)).alias("dst_idx"),
            F.lit(True).alias("is_load"), F.lit(kinds).alias("column_types"),
            F.lit(columns).cast("array<int>").alias("inspected_columns"),
            F.col("at").alias("started"),
            F.concat(F.lit(f"{base}/{CAPTURE_RUN}="), F.col("run_id")).alias("path"), F.lit(True).alias("captured"),
        ))

    # -- checks and verdicts ----------------------------------------------

    def check_run(self, scope: str, run_id: str, compat: bool = False) -> DataFrame:
        """Confidence of the run's inspected columns against its history."""
        return check_run(self.tables, scope, run_id, compat)

    def check_runs(self, scope: str, runs: DataFrame, compat: bool = False) -> DataFrame:
        """Confidence of many runs (``run_id``) of a scope, tested in one job."""
        return check_runs(self.tables, scope, runs, compat)

    def evaluate(
        self, scope: str, run_id: str, var: str, judge: float | Callable[[DataFrame], float | Column]
    ) -> DataFrame:
        """Credit a verdict on ``var`` to every operation upstream of it.

        ``judge`` is a number, or a function of the captured rows that returns a
        number or an aggregate column.
        """
        if callable(judge):
            rows = self.tables.read_capture(scope, var, run_id)
            verdict = judge(rows)
            if isinstance(verdict, Column):
                verdict = rows.agg(verdict.cast("double")).first()[0]
        else:
            verdict = judge
        columns = "scope STRING, run_id STRING, var STRING, feedback DOUBLE"
        return self.evaluate_many(one_row(self.spark, columns, {
            "scope": scope, "run_id": run_id, "var": var, "feedback": float(verdict)}))

    def evaluate_many(self, verdicts: DataFrame) -> DataFrame:
        """Credit many verdicts (``scope, run_id, var, feedback``); returns scores.

        A verdict on a variable that its run has not registered refuses them all.
        """
        scopes = self._scopes(verdicts)
        operations = self._within(self.tables.read("operations"), scopes)
        registered = operations.select(*lineage.RUN, F.col("dst_var").alias("var"))
        unknown = verdicts.join(registered, [*lineage.RUN, "var"], "left_anti").first()
        if unknown:
            raise KeyError(f"run {unknown['run_id']!r} in scope {unknown['scope']!r} has no variable {unknown['var']!r}")
        self.tables.write("scores", lineage.evaluate(operations, verdicts), dealt=_few(scopes))
        return self.scores()

    def scores(self) -> DataFrame:
        return lineage.scores(self.tables.read("scores"))

    # -- search -----------------------------------------------------------

    def runs_view(self) -> DataFrame:
        return search.current_runs(self.tables.read("runs"))

    def operations_view(self) -> DataFrame:
        """Operation records with their scores and confidence text."""
        confidence = (
            self.tables.read("confidence").where("confidence IS NOT NULL")
            .groupBy("scope", "run_id", "var")
            .agg(confidence_string(F.col("col_idx"), F.col("confidence")).alias("confidence"))
        )
        return search.current_operations(self.tables.read("operations"), self.scores(), confidence)

    def records(self) -> DataFrame:
        """Runs and operations as one searchable relation."""
        return search.union_metadata(self.runs_view(), self.operations_view())

    def search(self, sql: str = "SELECT * FROM records") -> DataFrame:
        """Hits: records selected by SQL over the view ``records``."""
        return search.metadata_sql(self.records(), sql)

    def search_meta(self, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
        return search.search_meta(hits)

    def search_semantics(self, hits: DataFrame) -> DataFrame:
        return search.search_semantics(hits, self.operations_view())

    def search_data(self, hits: DataFrame) -> DataFrame:
        """Rows of the hit captures as ``run_id, dstidx, dstvar, data``.

        Rows are rendered as comma-joined fields; run and variable come from
        the folder a row was read from.  A load that was not captured is read
        again as its format says: text and delimited files line by line.  One
        that cannot be read, or whose format is unknown, is a hit without data.
        The driver handles the hits, never their rows.
        """
        expanded = search.search_hits(hits, self.operations_view()).select(
            "scope", "run_id", F.col("dstvar").alias("dst_var"))
        key = ["scope", "run_id", "dst_var"]
        found = self.tables.read("operations").join(expanded, key, "left_semi").join(
            self.tables.read("loads").dropDuplicates(key), key, "left").withColumn("captured", captured())
        variables, loads, lost = defaultdict(dict), defaultdict(list), []
        for r in found.toLocalIterator():
            if r["captured"]:
                variables[r["scope"], r["dst_var"]][r["run_id"]] = r["dst_idx"]
            else:
                loads[r["path"], r["format"], r["columns"]].append((r["run_id"], r["dst_idx"], r["dst_var"]))
        parts = [
            self._captured_rows(scope, var, dict(some))
            for (scope, var), runs in variables.items() for some in _slices(list(runs.items()))
        ]
        for (path, kind, columns), readers in loads.items():
            rows = self._read_again(path, kind, columns)
            if rows is None:
                lost += [(*reader, None) for reader in readers]
                continue
            for some in _slices(readers):
                hit = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(h, ("run_id", "dstidx", "dstvar"))]) for h in some])
                parts.append(rows.select(F.explode(hit).alias("h"), "data").select("h.*", "data"))
        columns = "run_id STRING, dstidx STRING, dstvar STRING, data STRING"
        if lost:
            parts.append(self.spark.createDataFrame(lost, columns))
        return reduce(DataFrame.unionByName, parts) if parts else empty(self.spark, columns)

    def _captured_rows(self, scope: str, var: str, runs: dict[str, str]) -> DataFrame:
        """Rows of some runs' captures of a variable; only their folders are read."""
        frame = self.tables.read_captures(scope, var, sorted(runs))
        index = F.create_map(*[F.lit(x) for pair in runs.items() for x in pair])
        return frame.select(
            F.col(CAPTURE_RUN).alias("run_id"), index[F.col(CAPTURE_RUN)].alias("dstidx"), F.lit(var).alias("dstvar"),
            _joined(frame.drop(CAPTURE_RUN)).alias("data"),
        )

    def _read_again(self, path: str, kind: str | None, columns: str | None) -> DataFrame | None:
        try:
            if kind in ("text", "delimited"):
                return delimited.load_lines(self.spark, path).select(F.col("value").alias("data"))
            if kind is not None:
                frame = self.spark.read.format(kind).schema(T.StructType.fromJson(json.loads(columns))).load(path)
                return frame.select(_joined(frame).alias("data"))
        except AnalysisException:  # the path is gone
            pass
        return None


class Run:
    """One execution; load and capture return ordinary DataFrames."""

    def __init__(self, workspace: Workspace, scope: str, run_id: str):
        self.workspace, self.scope, self.run_id = workspace, scope, run_id
        self._spark, self._tables = workspace.spark, workspace.tables
        # a script's variables: the driver keeps names and indices only
        rows = self._tables.read("operations", scope=scope).where(F.col("run_id") == run_id).select(
            "dst_var", "dst_idx", captured().alias("captured")).collect()
        self._known: dict[str, str] = {r["dst_var"]: r["dst_idx"] for r in rows}
        self._stored = {r["dst_var"] for r in rows if r["captured"]}
        own = self._tables.read("runs", scope=scope).where(F.col("run_id") == run_id)
        self._finished = not own.where("event = 'finish'").isEmpty()

    def load(
        self,
        path: str,
        var: str,
        schema: str | T.StructType | int,
        sep: str = ",",
        tag: str | None = None,
        inspected: Sequence[str | int] = (),
        column_types: str | None = None,
        keep: bool = False,
    ) -> DataFrame:
        """Read delimited text and record the load.

        With ``keep`` the rows are also stored, so that loads can be tested
        like any other variable.
        """
        df = delimited.load_delimited(self._spark, path, schema, sep, tag)
        return self.loaded(df, path, var, inspected, column_types, keep, "delimited")

    def loaded(
        self,
        df: DataFrame,
        path: str,
        var: str,
        inspected: Sequence[str | int] = (),
        column_types: str | None = None,
        keep: bool = False,
        format: str | None = None,
    ) -> DataFrame:
        """Record a table read by other means as the load of ``var``.

        ``format`` (``text``, ``delimited``, or a reader's name such as
        ``parquet``) lets a search read an uncaptured load again.
        """
        self._open()
        if var in self._known:
            raise ValueError(f"'{var}' is registered in run {self.run_id} already")
        check_classes(df, column_types)
        if keep:
            df = self._store(df, var)
        index = f"{path}#{var}"
        where = self._tables.capture_path(self.scope, var, self.run_id) if keep else path
        self._register(df, var, [], LOAD_PREFIX + var, inspected, column_types, index, where, True, keep)
        if format and not keep:
            self._tables.write_row("loads", one_row(self._spark, schema.LOADS, {
                "scope": self.scope, "run_id": self.run_id, "dst_var": var, "format": format, "columns": df.schema.json()}))
        return df

    def capture(
        self,
        df: DataFrame,
        var: str,
        sources: Sequence[str],
        operation: str,
        inspected: Sequence[str | int] = (),
        column_types: str | None = None,
    ) -> DataFrame:
        """Store all rows of ``var`` and record ``sources -> operation -> var``.

        The returned DataFrame reads the stored rows, so nothing upstream is
        computed again.  Registering the same variable once more adds rows to it;
        a load that was not stored takes none, since no search would find them.
        """
        self._open()
        if var in self._known and var not in self._stored:
            raise ValueError(f"'{var}' of run {self.run_id} is a load without stored rows")
        check_classes(df, column_types)
        if var in sources:
            raise OrderViolation(f"variable '{var}' names itself as a source")
        unknown = [s for s in sources if s not in self._known]
        if unknown or not sources:
            raise OrderViolation(f"'{var}': sources {unknown} are not registered in run {self.run_id}")
        stored = self._store(df, var)
        path = self._tables.capture_path(self.scope, var, self.run_id)
        self._register(df, var, list(sources), operation, inspected, column_types, None, path, False, True)
        return stored

    def _open(self) -> None:
        if self._finished:
            raise RunFinished(f"run {self.run_id} is finished")

    def _store(self, df: DataFrame, var: str) -> DataFrame:
        if var not in self._known:
            return self._tables.write_capture(df, self.scope, var, self.run_id)
        growth = {"scope": self.scope, "var": var, "run_id": self.run_id, "growth": str(uuid.uuid4())}
        event = lambda writes: self._tables.write_row("growths", one_row(
            self._spark, schema.GROWTHS, {**growth, "at": F.current_timestamp(), "writes": writes}))
        event(None)
        before = self._tables.writes(self.scope, var, self.run_id)
        stored = self._tables.write_capture(df, self.scope, var, self.run_id, append=True)
        after = self._tables.writes(self.scope, var, self.run_id)
        if before is not None and after is not None:
            event(sorted(after - before))
        return stored

    def _register(self, df, var, sources, operation, inspected, column_types, index, path, is_load, stored) -> None:
        if var in self._known:
            return
        columns = inspect_columns(df, inspected)
        idx = F.lit(index) if index else lineage.operation_index(F.lit(self.scope), F.lit(self.run_id), F.lit(var))
        row = one_row(self._spark, schema.OPERATIONS, {
            "scope": self.scope, "run_id": self.run_id, "op_seq": len(self._known) + 1,
            "src_vars": sources, "src_idxs": [self._known[s] for s in sources],
            "operation": operation, "dst_var": var, "dst_idx": idx, "is_load": is_load,
            "column_types": column_types or column_classes(df), "inspected_columns": columns,
            "started": F.current_timestamp(), "path": path, "captured": stored,
        })
        self._tables.write_row("operations", row)
        self._known[var] = index or row.first()["dst_idx"]
        self._stored |= {var} if stored else set()

    def finish(self, check: bool = True, compat: bool = False) -> DataFrame | None:
        """Stamp the finish and test the run against earlier ones."""
        self._open()
        self.workspace._run_event(self.scope, self.run_id, None, "finish")
        self._finished = True
        return self.workspace.check_run(self.scope, self.run_id, compat) if check else None

    def evaluate(self, var: str, judge) -> DataFrame:
        return self.workspace.evaluate(self.scope, self.run_id, var, judge)


def one_row(spark: SparkSession, columns: str, values: dict) -> DataFrame:
    """A single typed row, built in the JVM."""
    def cell(name: str, kind: T.DataType) -> Column:
        value = values[name]
        if isinstance(value, list):
            value = F.array(*[F.lit(v) for v in value])
        elif not isinstance(value, Column):
            value = F.lit(value)
        return value.cast(kind).alias(name)

    return spark.range(0, 1, 1, 1).select(*[cell(f.name, f.dataType) for f in T.StructType.fromDDL(columns)])


def inspect_columns(df: DataFrame, inspected: Sequence[str | int]) -> list[int]:
    """Column numbers of the inspected columns; nested ones cannot be inspected."""
    numbers = [c if isinstance(c, int) else df.columns.index(c) for c in inspected]
    for i in numbers:
        if isinstance(df.schema[i].dataType, (T.ArrayType, T.MapType, T.StructType)):
            raise ValueError(f"column '{df.columns[i]}' is nested and cannot be inspected")
    return numbers


def check_classes(df: DataFrame, column_types: str | None) -> None:
    """Column types name a class, ``n`` or ``s``, for every column."""
    if column_types is not None:
        kinds = column_types.split(",")
        if len(kinds) != len(df.columns) or not set(kinds) <= {"n", "s"}:
            raise ValueError(f"column types {column_types!r} do not name one of n and s for each of {len(df.columns)} columns")


def column_classes(df: DataFrame) -> str:
    """``n`` for numeric and ``s`` for textual columns, comma-joined."""
    return ",".join("s" if trust.is_textual(kind) else "n" for _, kind in df.dtypes)


def _few(scopes: list[str] | None) -> bool:
    return scopes is not None and len(scopes) <= FEW_SCOPES


def _slices(items: list, size: int = 1000) -> list[list]:
    return [items[i:i + size] for i in range(0, len(items), size)]


def _joined(frame: DataFrame) -> Column:
    return F.array_join(F.array(*[_as_text(f) for f in frame.schema]), ",")


def _as_text(field: T.StructField) -> Column:
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        value = F.to_json(value)
    return F.coalesce(value.cast("string"), F.lit(""))
