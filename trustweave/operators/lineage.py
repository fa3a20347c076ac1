"""Operation log, lineage edges and the spread of an evaluation over them.

Everything is keyed by ``(scope, run_id)`` and handles any number of runs in
one job.  Runs are dealt to tasks whole, and a task peels the graphs of many runs
at once; only a run too large for that is walked level by level over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustweave.session import durable, scratch_path

RUN = ["scope", "run_id"]
LEVELS_PER_JOB = 3
#: A run whose operations and sources times its targets are more is walked over all tasks.
TASK_SIZE = 2_000_000
#: Rows of whole runs that a task takes at a time.
ROWS = 100_000
#: So many targets are sent to all tasks, which then read the log of their runs only.
FEW = 10_000
PATHS = "scope string, run_id string, target_idx string, dst_idx string, paths double"


class LineageCycle(ValueError):
    """The edges upstream of some target form a cycle."""


def operation_index(scope: Column, run_id: Column, dst_var: Column) -> Column:
    """Index of a derived variable: a name-based id, so a retry gives the same."""
    return F.md5(F.concat_ws("|", scope, run_id, dst_var))


def loader_index(path: Column, dst_var: Column) -> Column:
    """Index of a loaded variable: path and name, so two loads never collide."""
    return F.concat(path, F.lit("#"), dst_var)


def register_operations(requests: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One operation per ``(run, dst_var)``: the first registration wins.

    ``requests`` has the columns of the operation log without indices.  Indices
    are assigned here and the sources resolved against earlier registrations.
    Without the column ``captured``, no rows of theirs are stored.
    ``stored`` (``scope, run_id, dst_var, dst_idx``) is what the runs registered
    before: it comes before all requests, so it wins and resolves them.
    The deduplicated log is written once, since resolving reads it three times;
    indices that names give are made afterwards and not moved.
    """
    return resolve_registrations(first_registrations(requests), stored)


def first_registrations(requests: DataFrame) -> DataFrame:
    """The first of the requests for each ``(run, dst_var)``, written once."""
    if "captured" not in requests.columns:
        requests = requests.withColumn("captured", F.lit(False))
    return durable(_first_wins(requests), "requested")


def resolve_registrations(first: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Operations from first registrations, see :func:`register_operations`."""
    if stored is not None and not stored.isEmpty():
        first = durable(first.join(stored.select(*RUN, "dst_var"), [*RUN, "dst_var"], "left_anti"), "registered")
    loaded = F.when(F.col("is_load"), loader_index(F.col("path"), F.col("dst_var")))
    index = F.when(F.col("is_load"), loaded).otherwise(operation_index(F.col("scope"), F.col("run_id"), F.col("dst_var")))
    known = first.select(
        *RUN, F.col("dst_var").alias("src_var"), (~F.coalesce("is_load", F.lit(False))).alias("named"),
        loaded.alias("src_idx"), F.col("op_seq").alias("src_seq"))
    return _resolved(first, known, stored).withColumn("dst_idx", index)


def _known(operations: DataFrame, seq: Column) -> DataFrame:
    """Registrations as sources; an index that the name gives is not spelled out."""
    named = F.coalesce(F.col("dst_idx") == operation_index(F.col("scope"), F.col("run_id"), F.col("dst_var")), F.lit(False))
    return operations.select(
        *RUN, F.col("dst_var").alias("src_var"), named.alias("named"),
        F.when(~named, F.col("dst_idx")).alias("src_idx"), seq.alias("src_seq"))


def _before(stored: DataFrame) -> DataFrame:
    """Stored registrations as sources that come before all others."""
    return _known(stored, F.lit(-(2**63)))


def _first_wins(requests: DataFrame) -> DataFrame:
    rest = [c for c in requests.columns if c not in (*RUN, "dst_var")]
    return (
        requests.groupBy(*RUN, "dst_var")
        .agg(F.min_by(F.struct(*rest), "op_seq").alias("_first"))
        .select(*RUN, "dst_var", "_first.*")
    )


def _sources(operations: DataFrame) -> DataFrame:
    return operations.select(
        *RUN, "op_seq", "dst_var", F.posexplode("src_vars").alias("pos", "src_var")
    )


def resolve_src_idx(operations: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Look up each source variable's index among the run's earlier and ``stored`` operations.

    A source without an earlier registration leaves a null in ``src_idxs``;
    :func:`validate_order` reports it.
    """
    return _resolved(operations, _known(operations, F.col("op_seq")), stored)


def _resolved(operations: DataFrame, known: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Operations with ``src_idxs``; ``known`` is what they register themselves."""
    if stored is not None:
        known = known.unionByName(_before(stored))
    found = _sources(operations).join(known, [*RUN, "src_var"], "left")
    earlier = F.col("src_seq") < F.col("op_seq")
    source = F.struct("pos", F.when(earlier, F.col("named")).alias("named"), F.when(earlier, F.col("src_idx")).alias("idx"))
    # a list per operation, as long as the operation's own source list
    resolved = found.groupBy(*RUN, "dst_var").agg(F.array_sort(F.collect_list(source)).alias("_pairs"))
    index = lambda x: F.when(x.named, operation_index(F.col("scope"), F.col("run_id"), F.get("src_vars", x.pos))).otherwise(x.idx)
    kept = operations.drop("src_idxs")
    empty = F.array().cast("array<string>")
    return kept.join(resolved, [*RUN, "dst_var"], "left").withColumn(
        "src_idxs", F.coalesce(F.transform("_pairs", index), empty)
    ).drop("_pairs")


def validate_order(operations: DataFrame, runs: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Violations: unknown run, a source not registered before, a self source.

    ``stored`` is what the runs registered before these operations.
    """
    unknown = (
        operations.join(runs.select(*RUN).distinct(), RUN, "left_anti")
        .select(*RUN, "op_seq", "dst_var", F.lit(None).cast("string").alias("src_var"),
                F.lit("unknown_run").alias("violation"))
    )
    first = operations.groupBy(*RUN, F.col("dst_var").alias("src_var")).agg(F.min("op_seq").alias("src_seq"))
    if stored is not None:
        first = first.unionByName(_before(stored).drop("src_idx", "named"))
    is_self = F.col("src_var") == F.col("dst_var")
    late = F.col("src_seq").isNull() | (F.col("src_seq") >= F.col("op_seq"))
    order = (
        _sources(operations).join(first, [*RUN, "src_var"], "left")
        .where(is_self | late)
        .select(*RUN, "op_seq", "dst_var", "src_var",
                F.when(is_self, "self_source").otherwise("processing_order").alias("violation"))
    )
    return unknown.unionByName(order)


def lineage_edges(operations: DataFrame) -> DataFrame:
    """One row per source of each operation; a self-join lists its source twice."""
    return operations.select(*RUN, "dst_idx", F.explode("src_idxs").alias("src_idx"))


def path_counts(operations: DataFrame, targets: DataFrame) -> DataFrame:
    """Number of lineage paths from every ancestor to each target.

    ``targets`` has ``scope, run_id, dst_idx``.  The result has one row per
    target and ancestor, the target itself included with one path:
    ``scope, run_id, target_idx, dst_idx, paths``.  Counts are doubles: exact up to
    2^53, beyond that each addition rounds once (a relative error of at most
    2^-53 per edge on a path), and what exceeds 1.8e308 is infinite.
    """
    return _upstream(operations, targets)


def lineage_ancestors(operations: DataFrame, targets: DataFrame) -> DataFrame:
    """Everything upstream of each target, the target included, each once."""
    return _upstream(operations, targets).drop("paths")


def _upstream(operations: DataFrame, targets: DataFrame) -> DataFrame:
    """All runs together, whatever their sizes.

    An edge leads from an operation to a source that the same run registered,
    earlier or later; null and unknown sources lead nowhere, and neither do
    unknown targets.  A cycle upstream of a target is an error.
    ``targets`` may have a column ``note``: then each of them counts, and its note
    stands in all of its rows.
    """
    noted = [c for c in targets.columns if c == "note"]
    given = targets.select(*RUN, "dst_idx", *noted).dropna(subset=RUN)
    given = durable(given if noted else given.distinct(), "targets")
    log = operations.select(*RUN, "dst_idx", "src_idxs", *[c for c in operations.columns if c == "op_seq"])
    aims = given.groupBy(*RUN).agg(F.count(F.lit(1)).alias("targets"))
    if given.limit(FEW + 1).count() <= FEW:
        log = log.join(F.broadcast(aims.select(*RUN)), RUN, "left_semi")  # otherwise tasks drop what is not aimed at
    size = log.groupBy(*RUN).agg(F.sum(1 + F.greatest(F.size("src_idxs"), F.lit(0))).alias("size"))
    large = aims.join(size, RUN).where(F.col("targets") * F.col("size") > TASK_SIZE).select(*RUN)
    if not large.limit(2).collect():
        return _in_tasks(log, given)
    large = durable(large, "large-runs")
    inside = _in_tasks(log.join(large, RUN, "left_anti"), given.join(large, RUN, "left_anti"))
    some = given.join(large, RUN, "left_semi")
    outside = _over_tasks(log.join(large, RUN, "left_semi"), some.drop("note").distinct())
    if noted:
        outside = outside.join(some.withColumnRenamed("dst_idx", "target_idx"), [*RUN, "target_idx"])
    return inside.unionByName(outside)


def _in_tasks(log: DataFrame, targets: DataFrame) -> DataFrame:
    """Runs that fit into a task: one shuffle by run, and one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, last = 0, (None, False)
        for batch in batches:
            some, last = _aimed(batch, *last)
            held.append(some)
            count += some.num_rows
            if count >= ROWS:
                table = pa.Table.from_batches(held)
                done = int(np.searchsorted(number := _run_numbers(table), number[-1]))  # the last run may go on
                yield from _counted(table.slice(0, done))
                held, count = table.slice(done).to_batches(), table.num_rows - done
        if held:
            yield from _counted(pa.Table.from_batches(held))

    none = F.array().cast("array<string>")
    rows = log.drop("op_seq").withColumn("is_target", F.lit(False)).unionByName(
        targets.withColumns({"src_idxs": none, "is_target": F.lit(True)}), allowMissingColumns=True)
    # by a hash of the run: a plain repartition by columns by which both sides of the union are already dealt
    # would be left out of the plan, and adaptive execution then coalesces the sides apart from each other
    dealt = rows.repartition(F.xxhash64(*RUN)).sortWithinPartitions(*RUN, F.desc("is_target"))
    noted = [c for c in targets.columns if c == "note"]
    given = dealt.select(*RUN, "dst_idx", F.coalesce("src_idxs", none).alias("src_idxs"), "is_target", *noted)
    columns = PATHS + "".join(f", {c} {targets.schema[c].dataType.simpleString()}" for c in noted)
    counted = durable(given.mapInArrow(run, columns), "paths")
    bad = counted.where("paths IS NULL").first()
    if bad:
        raise LineageCycle(f"a cycle lies upstream of {bad['target_idx']!r} in run {bad['run_id']!r}")
    return counted


def _aimed(batch: pa.RecordBatch, last: tuple | None, last_aimed: bool) -> tuple[pa.RecordBatch, tuple]:
    """Rows of runs that have a target, which comes first; ``last`` is the run of the row before and whether it has one."""
    if not batch.num_rows:
        return batch, (last, last_aimed)
    number = _run_numbers(pa.Table.from_batches([batch]))
    name = lambda row: tuple(batch.column(c)[row].as_py() for c in RUN)
    aimed = batch.column("is_target").to_numpy(zero_copy_only=False)[np.flatnonzero(np.r_[True, number[1:] != number[:-1]])]
    if name(0) == last:
        aimed[0] = last_aimed
    return batch.filter(pa.array(aimed[number])), (name(batch.num_rows - 1), bool(aimed[-1]))


def _run_numbers(table: pa.Table) -> np.ndarray:
    """0, 0, 0, 1, ...: the run of each row, for rows sorted by run."""
    new = np.zeros(table.num_rows, np.int64)
    for c in RUN:
        code = table.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return np.cumsum(new)


def _counted(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Paths of whole runs: their operations numbered as one graph."""
    if not table.num_rows:
        return
    run, aimed = _run_numbers(table), table.column("is_target").to_numpy()
    sources = table.column("src_idxs").combine_chunks()
    name = pa.concat_arrays([table.column("dst_idx").combine_chunks(), sources.flatten()]).dictionary_encode()
    code, size = name.indices.fill_null(-1).to_numpy().astype(np.int64), max(1, len(name.dictionary))
    key = run * size + code[:len(run)]
    nodes = np.unique(key[~aimed & (code[:len(run)] >= 0)])
    if not len(nodes):
        return
    row = np.repeat(np.arange(len(run)), np.diff(sources.offsets.to_numpy()))
    source = np.where(code[len(run):] >= 0, run[row] * size + code[len(run):], -1)
    at = lambda keys: np.minimum(np.searchsorted(nodes, keys), len(nodes) - 1)
    known = (nodes[at(source)] == source) & (code[row] >= 0)
    edge, weight = np.unique(at(key[row[known]]) * len(nodes) + at(source[known]), return_counts=True)
    asked = np.flatnonzero(aimed)[nodes[at(key[aimed])] == key[aimed]]  # rows
    target = at(key[asked])
    first = np.searchsorted(nodes, np.arange(run[-1] + 2) * size)  # nodes of a run stand together
    of_run = nodes // size
    step = (first[of_run[target] + 1] - first[of_run[target]]).cumsum()
    row_of = np.full(run[-1] + 1, 0)
    row_of[run] = np.arange(len(run))  # some row of each run
    for rows in np.split(asked, np.searchsorted(step, np.arange(1, step[-1] // TASK_SIZE + 1) * TASK_SIZE)) if len(target) else []:
        part = at(key[rows])
        which, node, paths = _peeled(edge // len(nodes), edge % len(nodes), weight, part, first[of_run[part]], first[of_run[part] + 1])
        text = lambda k: name.dictionary.take(pa.array(nodes[k] % size))
        where = pa.array(row_of[of_run[node]])
        noted = [c for c in table.column_names if c == "note"]
        yield pa.RecordBatch.from_arrays(
            [table.column("scope").combine_chunks().take(where), table.column("run_id").combine_chunks().take(where), text(part[which]), text(node), paths,
             *[table.column(c).combine_chunks().take(pa.array(rows[which])) for c in noted]],
            ["scope", "run_id", "target_idx", "dst_idx", "paths", *noted])


def _fanned(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and the numbers of all ranges ``start, start + 1, ...``."""
    which = np.repeat(np.arange(len(start)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + start[which]


def _peeled(consumer: np.ndarray, source: np.ndarray, weight: np.ndarray, target: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Target, node and paths of everything upstream of each target; no count for a target above a cycle.

    Edges are sorted by consumer; the nodes of target i's run are ``low[i]`` to ``high[i]``.
    What is upstream is marked first; then a node is done when all of its
    consumers upstream are, so each edge counts once.  Nodes left over form cycles.
    """
    base = np.cumsum(high - low) - (high - low) - low  # state of a node for a target
    begin = np.searchsorted(consumer, np.arange(high.max(initial=0) + 1))

    def sources(which: np.ndarray, node: np.ndarray):
        own, edge = _fanned(begin[node], begin[node + 1] - begin[node])
        return own, which[own], source[edge], weight[edge]

    total = int((high - low).sum())
    seen, open_edges, paths = np.zeros(total, bool), np.zeros(total, np.int64), np.zeros(total)
    start = np.arange(len(target)), target
    seen[base + target] = True
    which, node = start
    while len(node):
        _, which, node, _ = sources(which, node)
        state = base[which] + node
        np.add.at(open_edges, state, 1)
        state, at = np.unique(state, return_index=True)
        new = ~seen[state]
        seen[state[new]] = True
        which, node = which[at[new]], node[at[new]]
    paths[base + target] = 1
    free = open_edges[base + target] == 0
    which, node = start[0][free], start[1][free]
    found = []
    while len(node):
        found.append((which, node))
        own, to, up, times = sources(which, node)
        state = base[to] + up
        np.add.at(paths, state, paths[base[which] + node][own] * times)
        np.subtract.at(open_edges, state, 1)
        state, at = np.unique(state, return_index=True)
        ready = open_edges[state] == 0
        which, node = to[at[ready]], up[at[ready]]
    which, node = (np.concatenate([start[k][:0], *[f[k] for f in found]]) for k in (0, 1))
    marked = np.r_[0, np.cumsum(seen)]
    stuck = np.bincount(which, minlength=len(target)) < marked[base + high] - marked[base + low]
    whole = ~stuck[which]
    bad = np.flatnonzero(stuck)
    counts = pa.array(np.r_[paths[base[which] + node][whole], np.zeros(len(bad))], mask=np.r_[np.zeros(whole.sum(), bool), np.ones(len(bad), bool)])
    return np.r_[which[whole], bad], np.r_[node[whole], target[bad]], counts


def _over_tasks(log: DataFrame, targets: DataFrame) -> DataFrame:
    """Runs too large for a task: breadth-first levels over all of them."""
    known = durable(log.select(*RUN, "dst_idx").distinct(), "nodes")
    given = targets.join(known, [*RUN, "dst_idx"], "left_semi")
    sources = known.withColumnRenamed("dst_idx", "src_idx")
    edges = durable(
        lineage_edges(log).join(sources, [*RUN, "src_idx"], "left_semi")
        .groupBy(*RUN, "dst_idx", "src_idx").agg(F.count(F.lit(1)).alias("w")), "edges")
    if not _in_order(edges, log):
        _refuse_cycles(edges, given)
    levels = _walk(edges, given.withColumnRenamed("dst_idx", "target_idx"))
    return levels.groupBy(*RUN, "target_idx", "dst_idx").agg(F.sum("paths").alias("paths"))


def _in_order(edges: DataFrame, log: DataFrame) -> bool:
    """Whether every source was registered before its consumer, so that there is no cycle."""
    if "op_seq" not in log.columns:
        return False
    number = log.groupBy(*RUN, "dst_idx").agg(F.min("op_seq").alias("first"), F.max("op_seq").alias("last"))
    consumers = edges.join(number.select(*RUN, "dst_idx", F.col("first").alias("read")), [*RUN, "dst_idx"])
    sources = number.select(*RUN, F.col("dst_idx").alias("src_idx"), F.col("last").alias("written"))
    return consumers.join(sources, [*RUN, "src_idx"]).where("coalesce(written >= read, true)").isEmpty()


def _refuse_cycles(edges: DataFrame, targets: DataFrame) -> None:
    """Take away operations without sources until none is left or nothing changes.

    What remains has a cycle upstream; rounds grow with the depth, not with the
    number of operations.
    """
    left = edges.select(*RUN, "dst_idx", "src_idx")
    before, count = None, left.count()
    while count and count != before:
        for _ in range(LEVELS_PER_JOB):
            consumers = left.select(*RUN, F.col("dst_idx").alias("src_idx")).distinct()
            left = left.join(consumers, [*RUN, "src_idx"], "left_semi")
        left = durable(left, "peeled")
        before, count = count, left.count()
    bad = targets.join(left, [*RUN, "dst_idx"], "left_semi").first() if count else None
    if bad:
        raise LineageCycle(f"a cycle lies upstream of {bad['dst_idx']!r} in run {bad['run_id']!r}")


def _walk(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Breadth-first levels of acyclic runs, written a few at a time.

    Paths are summed per node at every level, so a level never has more rows
    than its runs have nodes, however many paths there are.  Each job's levels
    are written to the shared folder and the next job starts from there.  Edges
    are hashed by node once, and only the frontier moves afterwards; a single
    run's edges spread over all partitions.
    """
    spark = edges.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = edges.repartition(parts, *RUN, "dst_idx").persist(StorageLevel.MEMORY_AND_DISK)

    def step(frontier: DataFrame) -> DataFrame:
        return (
            frontier.join(hashed, [*RUN, "dst_idx"])
            .groupBy(*RUN, "target_idx", F.col("src_idx").alias("dst_idx"))
            .agg(F.sum(F.col("paths") * F.col("w")).alias("paths"))
        )

    start = targets.select(*RUN, "target_idx", F.col("target_idx").alias("dst_idx"))
    frontier = start.withColumn("paths", F.lit(1.0))
    tables, depth, more = [], 0, True
    try:
        while more:
            levels = [frontier.withColumn("level", F.lit(depth))] if depth == 0 else []
            for _ in range(LEVELS_PER_JOB):
                frontier = step(frontier)
                depth += 1
                levels.append(frontier.withColumn("level", F.lit(depth)))
            path = scratch_path(spark, "levels")
            table = reduce(DataFrame.unionByName, levels)
            table.write.parquet(path)
            tables.append(path)
            frontier = spark.read.schema(table.schema).parquet(path).where(F.col("level") == depth).drop("level")
            more = not frontier.isEmpty()
    finally:
        hashed.unpersist()
    return spark.read.schema(table.schema).parquet(*tables)


def propagate_score(paths: DataFrame) -> DataFrame:
    """Score events: a target's verdicts times the paths from each ancestor.

    ``paths`` are noted with ``evaluated_var`` and all ``feedback`` of the target.
    """
    return paths.select(*RUN, "dst_idx", "paths", "note.evaluated_var", F.explode("note.feedback").alias("feedback")).select(
        *RUN,
        "dst_idx",
        (F.col("paths") * F.col("feedback")).alias("delta"),
        "evaluated_var",
        F.current_timestamp().alias("at"),
    )


def scores(events: DataFrame) -> DataFrame:
    """Current score of every operation that was ever credited."""
    return events.groupBy(*RUN, "dst_idx").agg(F.sum("delta").alias("score"))


def evaluate(operations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Score events for verdicts ``scope, run_id, var, feedback``.

    Every run named takes part whether it is finished or not.
    """
    given = verdicts.groupBy(*RUN, "var").agg(F.collect_list(F.struct(F.col("feedback").cast("double").alias("x"))).alias("feedback"))
    targets = given.join(operations.select(*RUN, F.col("dst_var").alias("var"), "dst_idx"), [*RUN, "var"]).select(
        *RUN, "dst_idx", F.struct(F.col("var").alias("evaluated_var"), F.col("feedback.x").alias("feedback")).alias("note"))
    return propagate_score(_upstream(operations, targets))
