import pytest
from pyspark.sql import functions as F

from trustweave.operators import trust
from trustweave.plans import anomaly, qualify, wifi
from trustweave.plans.workspace import OrderViolation
from trustweave.session import durable
from trustweave.sources.tables import CAPTURE_RUN

STANDARDS = "Windows,4096,512\nLinux,8192,256\nMac,1024,128\n"
SOFTWARES = """Wechat,Windows,4096,512,3.3
Chrome,Windows,2048,128,4.6
Minesweeper,Windows,64,32,3.7
Safari,Mac,1536,64,4.4
iTunes,Mac,512,64,4.8
Messages,Mac,512,256,4.1
Firefox,Linux,4096,128,3.5
Emacs,Linux,256,32,4.8
LibreOffice,Linux,1024,512,4.2
"""


@pytest.fixture
def qualified(workspace, tmp_path):
    (tmp_path / "standards.csv").write_text(STANDARDS)
    (tmp_path / "softwares.csv").write_text(SOFTWARES)
    run = workspace.start_run("StorePath", "Remark info")
    standards = run.load(str(tmp_path / "standards.csv"), "standards", "Platform STRING, MaxMem INT, MinMem INT")
    softwares = run.load(
        str(tmp_path / "softwares.csv"), "softwares",
        "Name STRING, Platform STRING, MaxMem INT, MinMem INT, Rate FLOAT")
    return run, qualify.qualify(run, standards, softwares)


def test_qualification_counts_scores_and_search(workspace, qualified, spark):
    run, counts = qualified
    assert {k: df.first()["cnt"] for k, df in counts.items()} == {"qualified": 6, "liked": 3, "disliked": 3}
    names = lambda var: {r["Name"] for r in workspace.tables.read_capture("StorePath", var, run.run_id).collect()}
    assert names("join2") == {"Chrome", "iTunes", "Emacs"}
    assert names("join3") == {"Wechat", "Minesweeper", "Firefox"}

    assert {r["status"] for r in run.finish().collect()} == {"not_inspected"}
    run.evaluate("join2", lambda rows: F.lit(1))
    scored = {r["dstvar"]: r["score"] for r in workspace.operations_view().collect()}
    assert scored == {"join2": 1, "qualified": 1, "liked": 1, "join1": 1, "standards": 1, "softwares": 2,
                      "disliked": 0, "join3": 0}

    hits = workspace.search("SELECT * FROM records WHERE dstvar IN ('join2', 'standards')")
    data = {(r["dstvar"], r["data"]) for r in workspace.search_data(hits).collect()}
    assert data == {("join2", n) for n in ("Chrome", "iTunes", "Emacs")} | {
        ("standards", x) for x in STANDARDS.split()}
    whole = workspace.search_data(workspace.search("SELECT * FROM records WHERE _type = 'run'"))
    assert whole.count() == 3 + 9 + 9 + 6 + 7 + 3 + 2 + 3
    runs, operations = workspace.search_meta(workspace.search())
    assert runs.count() == 1 and runs.first()["finish"] is not None and operations.count() == 8
    flows = {tuple(r)[1:] for r in workspace.search_semantics(hits).collect()}
    assert ("qualified,liked", "JOIN-2", "join2") in flows and ("-", "LOADER_standards", "standards") in flows
    nothing = workspace.search("SELECT * FROM records WHERE scope = 'none'")
    assert workspace.search_data(nothing).count() == 0


def test_order_is_validated_before_anything_is_stored(workspace, spark):
    run = workspace.start_run("s")
    df = spark.range(3)
    for sources in (["missing"], ["out"], []):
        with pytest.raises(OrderViolation):
            run.capture(df, "out", sources, "OP")
    assert workspace.tables.read("operations").count() == 0
    with pytest.raises(KeyError):
        workspace.run("s", "unknown")


def test_capture_again_adds_rows_and_keeps_the_registration(workspace, spark):
    run = workspace.start_run("s")
    run.loaded(spark.range(2), "p", "a")
    run.capture(spark.range(2), "b", ["a"], "FIRST")
    again = workspace.run("s", run.run_id)
    both = again.capture(spark.range(5), "b", ["a"], "SECOND")
    assert both.count() == 7
    log = workspace.tables.read("operations").where("dst_var = 'b'").collect()
    assert [(r["operation"], r["op_seq"]) for r in log] == [("FIRST", 2)]


def test_names_that_cannot_be_captured(workspace, spark):
    run = workspace.start_run("s")
    run.loaded(spark.range(2), "p", "a")
    twice = spark.range(2).select("id", F.col("id").alias("ID"))
    for df in (spark.range(2).withColumnRenamed("id", CAPTURE_RUN), twice):
        with pytest.raises(ValueError):
            run.capture(df, "b", ["a"], "OP")
    nested = spark.range(2).select(F.array("id").alias("bag"))
    with pytest.raises(ValueError):
        run.capture(nested, "b", ["a"], "OP", inspected=["bag"])


def normal_run(workspace, spark, seed, shift=0.0, run_id=None, var="out"):
    run = workspace.start_run("checks", run_id=run_id)
    df = spark.range(4000).select((F.randn(seed) + shift).alias("x"), F.concat(F.lit("t"), F.col("id") % 5).alias("t"))
    run.loaded(df, "generated", "in")
    run.capture(df, var, ["in"], "OP", inspected=["x", "t"])
    return run


def test_check_reuses_profiles_and_leaves_out_corrupted_runs(workspace, spark):
    first = normal_run(workspace, spark, 0).finish()
    assert {(r["status"], r["n_history"]) for r in first.collect()} == {("insufficient_history", 0)}
    for seed in range(1, 7):
        normal_run(workspace, spark, seed).finish(check=False)
    normal_run(workspace, spark, 7).finish()
    tables = workspace.tables
    before = tables.read("bucket_spec").collect()
    bad = normal_run(workspace, spark, 50, shift=4.0)
    flagged = {r["col_idx"]: r["corrupted"] for r in bad.finish().collect()}
    assert flagged[0] is True
    after = normal_run(workspace, spark, 51).finish().collect()
    row = next(r for r in after if r["col_idx"] == 0)
    assert (row["status"], row["n_history"]) == ("ok", 8)
    assert sorted(tables.read("bucket_spec").collect()) == sorted(before)
    # every capture is profiled once: 10 runs, 2 columns
    assert tables.read("profile").count() == 20
    mass = tables.read("dist").groupBy("run_id", "col_idx").agg(F.sum("p").alias("m"))
    assert mass.where("abs(m - 1) > 1e-9").count() == 0

    # checking once more replaces the result and does not count rows twice
    again = workspace.check_run("checks", bad.run_id)
    assert again.count() == 2 and tables.read("profile").count() == 20


def test_incremental_check_opens_only_the_new_run(workspace, spark, monkeypatch):
    for seed in range(3):
        normal_run(workspace, spark, seed).finish()
    opened = []
    read = workspace.tables.read_captures
    monkeypatch.setattr(workspace.tables, "read_captures", lambda s, v, r=None, c=None: opened.append(r) or read(s, v, r, c))
    last = normal_run(workspace, spark, 9)
    last.finish()
    assert opened == [[last.run_id]]


def test_variable_names_are_exact_and_run_ids_stay_text(workspace, spark):
    for i in range(3):
        normal_run(workspace, spark, i, run_id=f"00{i}")
        normal_run(workspace, spark, i, run_id=f"10{i}", var="x_out")
    row = workspace.check_run("checks", "002").first()
    assert (row["run_id"], row["n_history"]) == ("002", 2)
    assert {r[CAPTURE_RUN] for r in workspace.tables.read_captures("checks", "out").collect()} == {"000", "001", "002"}


def test_compat_rounds_like_the_original(workspace, spark):
    for seed in range(4):
        run = normal_run(workspace, spark, seed)
    run.finish(compat=True)
    for r in workspace.tables.read("bucket_spec").collect():
        assert r["base"] == float(f"{r['base']:.6g}") and r["step"] == float(f"{r['step']:.6g}")


def test_loads_can_be_checked_when_kept(workspace, spark):
    for seed in range(3):
        run = workspace.start_run("loads")
        run.loaded(spark.range(500).select(F.rand(seed).alias("x")), "p", "in", inspected=["x"], keep=True)
        result = run.finish()
    assert [r["var"] for r in result.collect()] == ["in"]
    assert workspace.search_data(workspace.search()).count() == 1500


def test_anomaly_demo(workspace, tmp_path):
    (tmp_path / "bounds.csv").write_text("0,50,10000,1\n")
    checked = anomaly.demonstrate(workspace, "demo", str(tmp_path / "bounds.csv"))
    flags = {
        (label, r["var"]): (r["status"], r["n_history"], r["corrupted"])
        for label, run in checked.items()
        for r in workspace.tables.read("confidence").where(F.col("run_id") == run.run_id).collect()}
    assert flags == {
        ("clean", "gen"): ("ok", 10, False), ("clean", "result"): ("ok", 10, False),
        ("perturbed", "gen"): ("ok", 11, False), ("perturbed", "result"): ("ok", 11, True)}
    # the judge takes the flagged variable down, and with it what it came from
    checked["perturbed"].evaluate("result", -1.0)
    view = workspace.operations_view().where(F.col("run_id") == checked["perturbed"].run_id)
    rows = {r["dstvar"]: r for r in view.collect()}
    assert {v: r["score"] for v, r in rows.items()} == {"raw": -1, "gen": -1, "result": -1}
    assert rows["result"]["confidence"].startswith("0:")


def test_access_log_sample(spark):
    from tests.test_relational import LOG, SEEN

    clock = lambda t: int(t[:2]) * 60 + float(t[3:])
    seconds, accesses = {}, {}
    for place, first, last, n in SEEN:
        seconds[place] = seconds.get(place, 0) + int((clock(last) - clock(first)) % 3600)
        accesses[place] = accesses.get(place, 0) + n
    order = lambda d: sorted(d.items(), key=lambda x: -x[1])
    lines = spark.createDataFrame([(x,) for x in LOG], "value STRING")
    assert [tuple(r) for r in wifi.time_rank(lines).collect()] == order(seconds)
    assert [tuple(r) for r in wifi.access_rank(lines).collect()] == order(accesses)
    density = {p: accesses[p] / seconds[p] for p in seconds}
    assert [tuple(r) for r in wifi.density_rank(lines).collect()] == order(density)


def test_search_reads_loads_by_their_format(workspace, spark, tmp_path):
    nation = spark.read.parquet("/root/testdata/sf0.001/nation.parquet").select("n_nationkey", "n_name")
    path = "/root/testdata/sf0.001/nation.parquet"
    run = workspace.start_run("formats")
    run.loaded(nation, path, "table", format="parquet")
    (tmp_path / "log.txt").write_text("a,b\nc,d\n")
    run.loaded(spark.read.text(str(tmp_path)), str(tmp_path), "lines", format="text")
    run.loaded(spark.range(3), "memory://nowhere", "gone")
    run.loaded(spark.range(3), str(tmp_path / "missing"), "missing", format="parquet")
    run.capture(nation.where("n_nationkey < 2"), "two", ["table"], "FILTER")
    data = workspace.search_data(workspace.search("SELECT * FROM records WHERE _type = 'run'"))
    found = {}
    for r in data.collect():
        found.setdefault(r["dstvar"], []).append(r["data"])
        assert r["run_id"] == run.run_id and r["dstidx"]
    assert len(found["table"]) == 25 and found["table"][0].startswith("0,") and sorted(found["lines"]) == ["a,b", "c,d"]
    assert found["gone"] == found["missing"] == [None] and len(found["two"]) == 2
    plan = data._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_refusals(workspace, spark):
    from trustweave.plans.workspace import RunFinished

    df = spark.range(3)
    for bad in ("a/b", "", "x y"):
        with pytest.raises(ValueError):
            workspace.start_run("refused", run_id=bad or " ")
    with pytest.raises(ValueError):
        workspace.import_history("refused", "v", df.withColumn("r", F.lit("a/b")), "r", F.current_timestamp())
    run = workspace.start_run("refused")
    run.loaded(df, "p1", "in")
    with pytest.raises(ValueError):
        run.loaded(df, "p2", "in")
    with pytest.raises(ValueError):
        run.capture(df.withColumn("t", F.lit("x")), "out", ["in"], "OP", column_types="n")
    for run_id, var in (("unknown", "in"), (run.run_id, "unknown")):
        with pytest.raises(KeyError):
            workspace.evaluate("refused", run_id, var, 1.0)
    assert workspace.scores().count() == 0
    run.finish()
    for late in (lambda: run.finish(), lambda: run.capture(df, "late", ["in"], "OP"), lambda: workspace.run("refused", run.run_id).loaded(df, "p", "x")):
        with pytest.raises(RunFinished):
            late()


def test_columns_are_found_by_name(workspace, spark):
    """History with its columns in another order, or without one, is profiled on the right column."""
    def one(seed, columns, shift=0.0):
        df = spark.range(4000).select((F.randn(seed) + shift).alias("x"), F.lit(1).alias("k"), F.lit("c").alias("t")).select(*columns)
        run = workspace.start_run("names", run_id=f"r{seed}")
        run.loaded(df, "made", "in")
        run.capture(df, "v", ["in"], "OP", inspected=["x"])
        return run

    for seed in range(4):
        one(seed, ["k", "x", "t"] if seed % 2 else ["x", "k", "t"])
    good = one(8, ["t", "x"]).finish().first()
    assert (good["status"], good["col_idx"], good["n_history"]) == ("ok", 1, 4)
    assert good["mu"] < 0.1 and good["jsd"] < 0.1
    bad = one(9, ["t", "k", "x"], 4.0).finish().first()
    assert bad["corrupted"] and bad["jsd"] > 0.3


def test_a_grown_capture_is_counted_on(workspace, spark, monkeypatch):
    for seed in range(5):
        normal_run(workspace, spark, seed)
    run = normal_run(workspace, spark, 9)
    before = workspace.check_run("checks", run.run_id).where("col_idx = 0").first()
    read, opened = workspace.tables.read_captures, []
    monkeypatch.setattr(workspace.tables, "read_captures", lambda s, v, r=None, c=None, writes=None: (
        opened.append((r, read(s, v, r, c, writes=writes).count())) or read(s, v, r, c, writes=writes)))
    run.capture(spark.range(4000).select((F.randn(5) + 6).alias("x"), F.lit("t0").alias("t")), "out", ["in"], "OP", inspected=["x", "t"])
    after = workspace.check_run("checks", run.run_id).where("col_idx = 0").first()
    assert after["jsd"] > 2 * before["jsd"]
    tables = workspace.tables
    grown = tables.read("profile").where((F.col("run_id") == run.run_id) & (F.col("col_idx") == 0))
    assert {(r["version"], r["n"]) for r in grown.collect()} == {(0, 4000), (1, 8000)}
    # only the new files were read; the distribution is that of all rows
    assert opened == [([run.run_id], 4000)]
    whole = tables.read_capture("checks", "out", run.run_id)
    spec = tables.read("bucket_spec")
    obs = trust.observations(whole.withColumn("run_id", F.lit(run.run_id)), {0: "x", 1: "t"}, [1])
    want = trust.histogram(obs, spec, [0, 1], "checks", "out")
    got = tables.read("dist").where(F.col("run_id") == run.run_id).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

    # unusable values are counted on as well; without the names of a growth all is read
    run.capture(spark.createDataFrame([(None, "t0")] * 3, "x DOUBLE, t STRING"), "out", ["in"], "OP")
    workspace.check_run("checks", run.run_id)
    writes = tables.writes
    monkeypatch.setattr(tables, "writes", lambda *a: None)
    run.capture(spark.createDataFrame([(None, "t0")] * 2, "x DOUBLE, t STRING"), "out", ["in"], "OP")
    monkeypatch.setattr(tables, "writes", writes)
    workspace.check_run("checks", run.run_id)
    assert opened[1:] == [([run.run_id], 3), ([run.run_id], 8005)]
    bad = tables.read("profile").where((F.col("run_id") == run.run_id) & (F.col("col_idx") == 0)).orderBy("version")
    assert [(r["n"], r["n_bad"]) for r in bad.collect()] == [(4000, 0), (8000, 0), (8000, 3), (8000, 5)]


def test_the_first_driver_freezes_a_spec(workspace, spark, monkeypatch):
    from trustweave import schema
    from trustweave.sources import tables as module

    spec = lambda *bases: spark.createDataFrame([("a/b:c", "v=1", i, b, 0.1) for i, b in enumerate(bases)], schema.BUCKET_SPEC)
    first, second = workspace.tables, module.Tables(spark, workspace.tables.root)
    first.write("bucket_spec", spec(1 / 3, float("-inf")))
    second.write("bucket_spec", spec(9.0, 9.0, 7.0))
    want = [("a/b:c", "v=1", 0, 1 / 3, 0.1), ("a/b:c", "v=1", 1, float("-inf"), 0.1), ("a/b:c", "v=1", 2, 7.0, 0.1)]
    for rows in first.read("bucket_spec"), second.read("bucket_spec", scope="a/b:c"):
        assert sorted(map(tuple, rows.collect())) == want
    assert first.read("bucket_spec", compat=True).count() == 0 == first.read("bucket_spec", scope="a").count()
    # a driver that died between creating its file and writing it is reported, not taken for a column without values
    path = first.read("bucket_spec").inputFiles()[0].removeprefix("file:").replace("%25", "%").replace("///", "/")
    open(path, "w").close()
    monkeypatch.setattr(module, "SPEC_SECONDS", 0.2)
    with pytest.raises(RuntimeError, match="begun and not written"):
        second.write("bucket_spec", spec(9.0, 9.0, 7.0))


def test_both_ways_of_profiling_are_kept_apart(workspace, spark):
    for seed in range(5):
        normal_run(workspace, spark, seed)
    plain = workspace.check_run("checks", normal_run(workspace, spark, 9, run_id="last").run_id).orderBy("col_idx").collect()
    compat = workspace.check_run("checks", "last", compat=True).orderBy("col_idx").collect()
    assert [r["jsd"] for r in plain] != [r["jsd"] for r in compat]
    base = workspace.tables.read("bucket_spec", compat=True).where("col_idx = 0").first()["base"]
    assert base == float(f"{base:.6g}")
    assert workspace.check_run("checks", "last").orderBy("col_idx").collect() == plain


def test_many_operations_are_written_and_compacted(workspace, spark):
    requests = spark.range(1, 101).select(
        F.lit("a/b:c").alias("scope"), F.lit("r").alias("run_id"), F.col("id").alias("op_seq"),
        F.when(F.col("id") > 1, F.array(F.concat(F.lit("v"), F.col("id") - 1))).otherwise(F.array().cast("array<string>")).alias("src_vars"),
        F.lit("OP").alias("operation"), F.concat(F.lit("v"), F.col("id")).alias("dst_var"), (F.col("id") == 1).alias("is_load"),
        F.lit("n").alias("column_types"), F.array().cast("array<int>").alias("inspected_columns"),
        F.current_timestamp().alias("started"), F.lit("p").alias("path"))
    runs = spark.createDataFrame([("a/b:c", "r", "many")], "scope STRING, run_id STRING, info STRING").withColumn("at", F.current_timestamp())
    workspace.start_runs(runs)
    assert workspace.register(requests).count() == 100
    files = lambda name: len(workspace.tables.read(name).inputFiles())
    assert files("operations") <= 8
    assert workspace.tables.read("operations", scope="a/b:c").count() == 100 and workspace.tables.read("operations", scope="a").count() == 0
    for i in range(5):
        workspace.start_run("a/b:c", run_id=f"s{i}")
    assert files("runs") >= 6
    workspace.compact()
    assert files("runs") == 1 and workspace.tables.read("runs").count() == 6 and workspace.tables.read("operations").count() == 100
    workspace.finish_runs(runs.drop("info"))
    with pytest.raises(ValueError):
        workspace.finish_runs(runs.drop("info"))
    assert workspace.evaluate("a/b:c", "r", "v100", 1.0).count() == 100


def batch(spark, *steps, run="r"):
    rows = [("s", run, seq, src, "OP", var, not src, "n", [], f"p/{var}") for seq, var, src in steps]
    return spark.createDataFrame(
        rows, "scope STRING, run_id STRING, op_seq LONG, src_vars ARRAY<STRING>, operation STRING, dst_var STRING, is_load BOOLEAN, "
        "column_types STRING, inspected_columns ARRAY<INT>, path STRING").withColumn("started", F.current_timestamp())


def test_registration_in_batches(workspace, spark):
    workspace.start_run("s", run_id="r")
    workspace.start_run("s", run_id="done").finish(check=False)
    workspace.register(batch(spark, (1, "v1", []), (2, "v2", ["v1"])))
    second = workspace.register(batch(spark, (1, "v3", ["v1", "v2"]), (2, "v1", []), (3, "v4", ["v3"])))
    assert {r["dst_var"] for r in second.collect()} == {"v3", "v4"}  # v1 stays as it was
    stored = {r["dst_var"]: r for r in workspace.tables.read("operations").collect()}
    assert len(stored) == 4 == workspace.tables.read("operations").count()
    assert stored["v3"]["src_idxs"] == ["p/v1#v1", stored["v2"]["dst_idx"]] and stored["v4"]["src_idxs"] == [stored["v3"]["dst_idx"]]
    assert workspace.evaluate("s", "r", "v4", 1.0).where("score = 2").count() == 1  # v1, along two paths
    for wrong in [(4, "v5", ["v6"])], [(4, "v5", ["v5"])], [(4, "v6", ["v7"]), (5, "v7", [])]:
        with pytest.raises(OrderViolation):
            workspace.register(batch(spark, *wrong))
    for run in ("nobody", "done"):
        with pytest.raises(KeyError):
            workspace.register(batch(spark, (1, "v1", []), run=run))
    assert workspace.tables.read("operations").count() == 4


def test_a_load_of_another_runs_capture_is_no_capture(workspace, spark):
    rows = spark.createDataFrame([(1.0,), (2.0,)], "x DOUBLE")
    first = workspace.start_run("one")
    first.loaded(rows, "memory", "raw")
    first.capture(rows, "kept", ["raw"], "OP")
    first.finish(check=False)
    second = workspace.start_run("two")
    path = workspace.tables.capture_path("one", "kept", first.run_id)
    second.loaded(spark.read.parquet(path), path, "given", inspected=["x"], format="parquet")
    assert second.finish().where("status = 'not_inspected'").count() >= 0
    found = workspace.search_data(workspace.search("SELECT * FROM records WHERE scope = 'two' AND dstvar = 'given'")).collect()
    assert sorted(r["data"] for r in found) == ["1.0", "2.0"]


def test_a_load_without_stored_rows_takes_none(workspace, spark):
    rows = spark.createDataFrame([(1,)], "x INT")
    run = workspace.start_run("one")
    run.loaded(rows, "memory", "raw")
    run.loaded(rows, "memory", "kept", keep=True)
    with pytest.raises(ValueError):
        run.capture(rows, "raw", ["kept"], "OP")
    again = workspace.run("one", run.run_id)
    with pytest.raises(ValueError):
        again.capture(rows, "raw", ["kept"], "OP")
    assert again.capture(rows, "kept", ["raw"], "OP").count() == 2


def test_history_is_imported_once(workspace, spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "run STRING, x INT")
    started = F.max(F.lit("2024-01-01"))
    workspace.import_history("s", "v", rows, "run", started, ["x"])
    with pytest.raises(ValueError):
        workspace.import_history("s", "v", rows.where("run = 'b'"), "run", started, ["x"])
    workspace.import_history("s", "w", rows, "run", started, ["x"])
    assert workspace.tables.read("runs").count() == 4 and workspace.tables.read("operations").count() == 4
    assert workspace.runs_view().where("finish IS NOT NULL").count() == 2


def test_runs_finished_in_bulk_are_checked(workspace, spark):
    for seed in range(6):
        normal_run(workspace, spark, seed, run_id=f"r{seed}")
    normal_run(workspace, spark, 6, shift=4.0, run_id="bad")
    other = workspace.start_run("other", run_id="r0")
    other.loaded(spark.range(3), "p", "in", keep=True)
    ends = spark.createDataFrame(
        [("checks", r) for r in ("r3", "r4", "bad")] + [("other", "r0")], "scope STRING, run_id STRING").withColumn("at", F.current_timestamp())
    rows = workspace.finish_runs(ends, check=True).collect()
    assert {(r["scope"], r["run_id"], r["col_idx"]): r["corrupted"] for r in rows if r["status"] != "not_inspected"} == {
        ("checks", r, c): (r, c) == ("bad", 0) for r in ("r3", "r4", "bad") for c in (0, 1)}
    assert [(r["scope"], r["status"]) for r in rows if r["status"] == "not_inspected"] == [("other", "not_inspected")]
    assert {r["n_history"] for r in rows if r["run_id"] in ("r3", "r4")} == {6}
    assert workspace.tables.read("profile").count() == 14  # every capture once
    # the flag holds from now on; a run checked alone gets what a batch of one gets
    alone = workspace.check_run("checks", "r5").orderBy("col_idx").collect()
    assert {r["n_history"] for r in alone} == {5}
    batch = workspace.check_runs("checks", spark.createDataFrame([("r5",)], "run_id STRING")).orderBy("col_idx").collect()
    assert [a["status"] for a in alone] == ["ok", "degenerate_history"] == [b["status"] for b in batch]
    assert [a["jsd"] for a in alone] == pytest.approx([b["jsd"] for b in batch], abs=1e-12)
    assert alone[0]["log_density"] == pytest.approx(batch[0]["log_density"], rel=1e-6)
    assert workspace.check_runs("checks", spark.createDataFrame([], "run_id STRING")).count() == 0


def test_a_variable_registered_in_several_ways_is_checked_in_bulk(workspace, spark):
    for seed in range(6):
        df = spark.range(500).select(F.randn(seed).alias("x"), F.randn(seed + 50).alias("y"))
        run = workspace.start_run("ways", run_id=f"r{seed}")
        run.loaded(df, "p", "in", inspected=["x", "y"] if seed % 2 else ["x"], keep=True)
    runs = workspace.tables.read("runs").select("run_id").distinct()
    rows = workspace.check_runs("ways", runs).collect()
    assert {(r["run_id"], r["col_idx"]) for r in rows} == {(f"r{s}", c) for s in range(6) for c in range(1 + s % 2)}
    assert {(r["status"], r["n_history"]) for r in rows} == {("ok", 5)}
    assert workspace.tables.read("dist").select("run_id", "col_idx").distinct().count() == 12


def test_what_is_stored_is_compressed(workspace, spark):
    """Captures, metadata and intermediate tables, in zstd."""
    run = workspace.start_run("s")
    rows = run.loaded(spark.range(50), "p", "a")
    run.capture(rows, "b", ["a"], "op")
    workspace.import_history("h", "x", rows.withColumn("r", (F.col("id") % 2).cast("string")), "r", F.lit("2024-01-01 00:00:00"))
    tables = workspace.tables
    for stored in (tables.read_capture("s", "b", run.run_id), tables.read_captures("h", "x"), tables.read("operations"), durable(rows, "rows")):
        files = stored.inputFiles()
        assert files and all(".zstd." in f for f in files)


def test_a_batch_in_order_is_not_validated_source_by_source(workspace, spark, monkeypatch):
    columns = ("scope STRING, run_id STRING, op_seq LONG, src_vars ARRAY<STRING>, operation STRING, dst_var STRING, is_load BOOLEAN, "
               "column_types STRING, inspected_columns ARRAY<INT>, started TIMESTAMP, path STRING")
    steps = lambda run, *steps: spark.createDataFrame(
        [("s", run, i, src, "op", var, not src, "n", [], None, "p") for i, (var, src) in enumerate(steps)], columns)
    workspace.start_runs(spark.createDataFrame([("s", "r", "", None)], "scope STRING, run_id STRING, info STRING, at TIMESTAMP"))
    with monkeypatch.context() as patched:
        patched.setattr("trustweave.operators.lineage.validate_order", lambda *_: pytest.fail("joined"))
        workspace.register(steps("r", ("a", []), ("b", ["a", "a"])))
        workspace.register(steps("r", ("c", ["b"]), ("a", ["zz"])))  # a is there already
    for bad, error in (
        (steps("r", ("d", ["zz"])), OrderViolation), (steps("r", ("d", ["d"])), OrderViolation),
        (steps("r", ("d", ["e"]), ("e", ["a"])), OrderViolation), (steps("q", ("d", [])), KeyError),
    ):
        with pytest.raises(error):
            workspace.register(bad)
    log = {r["dst_var"]: r["src_idxs"] for r in workspace.tables.read("operations").collect()}
    b = workspace.tables.read("operations").where("dst_var = 'b'").first()["dst_idx"]
    assert log == {"a": [], "b": ["p#a", "p#a"], "c": [b]}


def test_requests_are_computed_once(workspace, spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [("s", "r", i, ["a"] if i else [], "op", "abc"[i], not i, "n", [], None, "p") for i in range(3)]
    requests = spark.createDataFrame(rows, (
        "scope STRING, run_id STRING, op_seq LONG, src_vars ARRAY<STRING>, operation STRING, dst_var STRING, is_load BOOLEAN, "
        "column_types STRING, inspected_columns ARRAY<INT>, started TIMESTAMP, path STRING"))
    workspace.start_runs(spark.createDataFrame([("s", "r", "", None)], "scope STRING, run_id STRING, info STRING, at TIMESTAMP"))
    assert workspace.register(requests.mapInArrow(counted, requests.schema)).count() == 3
    assert seen.value == 3
    assert workspace.register(requests.mapInArrow(counted, requests.schema)).count() == 0
    assert seen.value == 6
