"""Corpus, graph, logs, reports, chat and files on inline rows."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkrecon.functions import text as X
from sparkrecon.functions import timing as M
from sparkrecon.functions.text import split_outside
from sparkrecon.operators import chat, corpus, graph, logs, report, selection, triage
from sparkrecon.plans.lineage import scratch_path
from sparkrecon.sources import text as IO

SOURCE = """\
C     header comment
      SUBROUTINE ALPHA(N,
     +   X, Y)
      IMPLICIT REAL (A-H, O-Z), INTEGER (P)
      INTEGER N, M(3,
      DOUBLE PRECISION X(N,*), Y(*)
      REAL X
      CHARACTER*6 Y
*     CALL GHOST(N)
      CALL BETA(X) ! CALL HIDDEN(X)
      WRITE(*,*) 'wow! F(' , MAX(1,2)
      END
      REAL FUNCTION BETA(A)
      BETA = ALPHA(A)
      END FUNCTION BETA
      SUBROUTINE NOPAREN
      X = 1
      SUBROUTINE INNER(Q)
      END
"""


def one(spark, text, doc="src/a.b.f"):
    return spark.createDataFrame([(doc, text)], "doc string, text string")


def test_lines_follow_every_line_end(spark):
    texts = ["", "a", "a\n", "a\n\n", "a\r\nb\rc", "\n", "a b\x0cc", "x\x85y\r\n"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, text string")
    got = {r["n"]: r["l"] for r in df.select("n", X.lines_of(F.col("text")).alias("l")).collect()}
    assert got == {n: t.splitlines() for n, t in enumerate(texts)}


def test_units_and_headers(spark):
    found = corpus.unit_header(corpus.units(one(spark, SOURCE))).orderBy("unit").collect()
    assert [(r["name"], r["kind"], r["return_type"], r["args"], r["line_count"]) for r in found] == [
        ("ALPHA", "subroutine", None, ["N", "X", "Y"], 11),
        ("BETA", "function", "REAL", ["A"], 3),
        ("NOPAREN", "subroutine", None, [], 4),
    ]


def test_whole_file_counts_when_no_unit(spark, rows):
    df = spark.createDataFrame([("d/x.y.f", "  X = 1\n"), ("d/blank.f", " \n\n")], "doc string, text string")
    found = corpus.unit_header(corpus.units(df))
    assert rows(found, "doc", "name", "kind", "whole") == [("d/x.y.f", "X.Y", "subroutine", True)]


def test_declarations_last_wins_and_default(spark, rows):
    headed = corpus.unit_header(corpus.units(one(spark, SOURCE))).filter("name = 'ALPHA'")
    got = rows(corpus.declarations(headed), "arg_ord", "arg", "ftype", "dims")
    # REAL X comes later than the array; CHARACTER*6 is no recognised prefix.
    assert got == [
        (0, "N", "INTEGER", []), (1, "X", "REAL", []), (2, "Y", "DOUBLE PRECISION", ["*"]),
    ]


def test_implicit_rules(spark):
    docs = spark.createDataFrame(
        [
            ("a", "      SUBROUTINE A(X)\n      IMPLICIT DOUBLE PRECISION (A-C, i, X-Z)\n      END\n"),
            ("b", "      SUBROUTINE B(X)\n      IMPLICIT REAL (I)\n      implicit none\n      END\n"),
            ("c", "      SUBROUTINE C(X)\n      END\n"),
            ("d", "      SUBROUTINE D(X)\n      IMPLICIT REAL * 8(A-H,O-Z)\n      IMPLICIT INTEGER*2 (H)\n      END\n"),
        ],
        "doc string, text string",
    )
    got = {(r["doc"], r["letter"]): r["ftype"] for r in corpus.implicit_types(corpus.units(docs)).collect()}
    assert len(got) == 78 and not any(d == "b" for d, _ in got)
    assert (got[("d", "A")], got[("d", "H")], got[("d", "I")], got[("d", "Z")]) == ("REAL*8", "INTEGER*2", "INTEGER", "REAL*8")
    assert got[("a", "B")] == got[("a", "I")] == got[("a", "Z")] == "DOUBLE_PRECISION"
    assert (got[("a", "D")], got[("a", "J")], got[("c", "I")], got[("c", "A")]) == ("REAL", "INTEGER", "INTEGER", "REAL")
    plan = corpus.implicit_types(corpus.units(docs))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_call_edges_skip_comments_keywords_and_self(spark, rows):
    headed = corpus.unit_header(corpus.units(one(spark, SOURCE)))
    edges = corpus.call_edges(headed)
    # A quoted exclamation mark keeps the line; array references look like calls.
    assert rows(edges) == [("ALPHA", "BETA"), ("BETA", "ALPHA"), ("NOPAREN", "INNER")]
    assert rows(corpus.known_edges(edges, headed)) == [("ALPHA", "BETA"), ("BETA", "ALPHA")]


def test_code_part(spark, rows):
    df = spark.createDataFrame([("a = 1 ! x",), ("b = '!'",), ("c = 'x' ! y ! z",), ("d",)], "line string")
    got = [r[0] for r in df.select(corpus.code_part(F.col("line"))).collect()]
    assert got == ["a = 1", "b = '!'", "c = 'x'", "d"]


def test_levels_with_cycle_and_diamond(spark):
    edges = spark.createDataFrame(
        [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "y"), ("y", "x"), ("z", "x"), ("a", "a"), ("d", "gone")],
        "src string, dst string",
    )
    nodes = spark.createDataFrame([(n,) for n in "abcdxyze"], "node string")
    got = {r["node"]: r["level"] for r in graph.topo_levels(edges, nodes).collect()}
    assert got == {"d": 0, "e": 0, "b": 1, "c": 1, "a": 2, "x": None, "y": None, "z": None}


def test_levels_beyond_the_broadcast_limit(spark, monkeypatch):
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 0)
    edges = spark.createDataFrame([(n, n // 2) for n in range(1, 40)], "src int, dst int")
    nodes = spark.createDataFrame([(n,) for n in range(40)], "node int")
    got = {r["node"]: r["level"] for r in graph.topo_levels(edges, nodes).collect()}
    assert got == {n: n.bit_length() for n in range(40)}


def _levels_by_hand(edges, nodes):
    needs = {n: {d for s, d in edges if s == n and d != n and d in nodes} for n in nodes}
    found = {}
    while True:
        ready = [n for n in nodes if n not in found and needs[n] <= set(found)]
        if not ready:
            return {n: found.get(n) for n in nodes}
        found |= {n: 1 + max((found[d] for d in needs[n]), default=-1) for n in ready}


@pytest.mark.parametrize("broadcast", [0, 500_000])
def test_levels_of_random_graphs(spark, monkeypatch, broadcast):
    """Chains, trees, nodes with several needs, cycles and ways into them."""
    monkeypatch.setattr(graph, "BROADCAST_ROWS", broadcast)
    rng = random.Random(3)
    edges = [(n, n - 1) for n in range(1, 40)]
    edges += [(n, rng.randrange(n)) for n in range(40, 150)]
    edges += [(n, rng.randrange(n)) for n in range(60, 150) if rng.random() < 0.3]
    edges += [(200, 201), (201, 202), (202, 200), (203, 202), (204, 203), (204, 1), (205, 204), (300, 999)]
    nodes = [*range(150), *range(200, 206), 300]
    got = graph.topo_levels(
        spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(n,) for n in nodes], "node int")
    )
    assert {r["node"]: r["level"] for r in got.collect()} == _levels_by_hand(edges, nodes)
    assert got.count() == len(nodes)


def test_levels_without_edges(spark):
    edges = spark.createDataFrame([(1, 1), (2, 9)], "src int, dst int")
    nodes = spark.createDataFrame([(1,), (2,), (2,)], "node int")
    assert sorted(map(tuple, graph.topo_levels(edges, nodes).collect())) == [(1, 0), (2, 0)]
    assert graph.topo_levels(edges.limit(0), nodes.limit(0)).collect() == []


def test_a_tree_takes_few_jobs(spark, monkeypatch):
    """17 levels: three rounds of jumps after the edges and the pointers, and no round of counts."""
    jumps, settles = [], []
    observe = graph.Observation
    monkeypatch.setattr(graph, "Observation", lambda: jumps.append(1) or observe())
    monkeypatch.setattr(graph, "_settled", lambda *a: settles.append(1))
    edges = spark.range(1, 1 << 16).select(F.col("id").alias("src"), F.shiftright("id", 1).alias("dst"))
    nodes = spark.range(1 << 16).withColumnRenamed("id", "node")
    got = graph.topo_levels(edges, nodes)
    # one observation with the pointers, one per round
    assert len(jumps) == 4 and not settles
    assert got.filter("level <> CASE node WHEN 0 THEN 0 ELSE length(bin(node)) END OR level IS NULL").count() == 0


def test_adjacency(spark, rows):
    edges = spark.createDataFrame([("a", "c"), ("a", "b"), ("a", "b"), ("b", "c")], "src string, dst string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    assert rows(graph.render_adjacency(edges, nodes)) == [("a", "b, c"), ("b", "c"), ("c", "(leaf)")]
    assert ("c", None) in rows(graph.adjacency(edges, nodes))


LOG = "\n\nerror one\n --> src/alpha.rs:1:2\n \nnote src/lib.rs:3\n\nerror two\n --> src/beta.rs:9\nmore\n  "


def test_error_blocks_forms_agree(spark, rows):
    text = spark.createDataFrame([("l1", LOG), ("l2", "nothing\n\nhere")], "log string, text string")
    got = {r["log"]: r["blocks"] for r in logs.error_blocks_in_text(text, F.lit("src/beta.rs")).collect()}
    assert got == {"l1": "error two\n --> src/beta.rs:9\nmore", "l2": "nothing\n\nhere"}
    lines = corpus.line_table(text)
    hit = logs.error_blocks(lines, F.col("line").contains("src/beta.rs"), block=2)
    found = hit.filter("log = 'l1'").orderBy("ln").select("ln", "line").collect()
    assert [tuple(r) for r in found] == [(8, "error two"), (9, " --> src/beta.rs:9"), (10, "more")]
    assert hit.filter("log = 'l2'").count() == 3
    assert rows(logs.failing_modules(lines)) == [("l1", "alpha", 4), ("l1", "beta", 9)]


def test_fences_tags_and_ellipsis(spark):
    row = spark.range(1).select(
        X.strip_fences(F.lit("  ```rust\nfn a() {}\n```\n")).alias("f"),
        X.strip_fences(F.lit("plain")).alias("p"),
        F.array_join(X.rule_tags(F.lit("x lsame y GO TO xerbla implicit external")), ",").alias("t"),
        F.array_join(X.rule_tags(F.lit("implicit")), ",").alias("g"),
        X.truncate_ellipsis(F.lit("éabc"), 2).alias("e"),
        X.truncate_ellipsis(F.lit("éa"), 2).alias("e2"),
        X.escape_html(F.lit("<a href='x'>\"&\"</a>")).alias("h"),
        X.run_stamp(F.lit("report_20260315_030100")).cast("string").alias("s"),
        X.run_stamp(F.lit("report_20261315_030100")).alias("bad"),
        X.run_stamp(F.lit("run")).alias("none"),
    ).first()
    assert (row["f"], row["p"]) == ("fn a() {}", "plain")
    assert row["t"] == "case_insensitive_compare,goto,error_handler" and row["g"] == "numeric_semantics"
    assert (row["e"], row["e2"]) == ("éa…", "éa")
    assert row["h"] == "&lt;a href=&#x27;x&#x27;&gt;&quot;&amp;&quot;&lt;/a&gt;"
    assert (row["s"], row["bad"], row["none"]) == ("2026-03-15 03:01:00", None, None)


def test_timing_treats_zero_as_missing(spark):
    row = spark.range(1).select(
        M.speedup(F.lit(4.0), F.lit(2.0)).alias("a"),
        M.speedup(F.lit(0.0), F.lit(2.0)).alias("b"),
        M.speedup(F.lit(4.0), F.lit(0.0)).alias("c"),
        M.ms_per_call(F.lit(10.0), F.lit(0)).alias("d"),
        M.bench_summary(F.lit(4.0), F.lit(2.0), F.lit(None).cast("string"), "A", "B").alias("s"),
        M.bench_summary(F.lit(4.0), F.lit(0.0), F.lit(""), "A", "B").alias("t"),
        M.bench_summary(F.lit(4.0), F.lit(8.0), F.lit("boom")).alias("u"),
    ).first()
    assert (row["a"], row["b"], row["c"], row["d"]) == (2.0, None, None, None)
    assert row["s"] == "A: 4.000 ms  |  B: 2.000 ms  |  B is 2.00x faster than A"
    assert row["t"] == "A: 4.000 ms  |  B: N/A" and row["u"] == "Benchmark failed: boom"


def test_strategy_overview_states(spark):
    runs = spark.createDataFrame(
        [(1, True, True, None, 2), (2, True, False, "late", 1), (3, True, True, "down", 0), (4, None, True, None, 1)],
        "strategy int, build_ok boolean, test_ok boolean, error string, n_conversions int",
    )
    acc = spark.createDataFrame(
        [(1, True, 1e-12), (1, False, None), (2, False, None), (3, True, 1e-12)],
        "strategy int, passed boolean, max_abs_error double",
    )
    bench = spark.createDataFrame([(1, 2.0), (1, 0.0), (1, None), (2, 0.0)], "strategy int, speedup double")
    got = {r["strategy"]: tuple(r)[1:] for r in report.strategy_overview(runs, acc, bench).collect()}
    assert got == {
        1: ("✅", "✅", "✅", 1e-12, 2.0),
        2: ("✅", "❌", "✅", None, None),  # nothing measured counts as passed
        3: ("❌", "❌", "❌", None, None),
        4: ("❌", "✅", "—", None, None),
    }


def test_retry_set_and_ledger(spark, rows):
    acc = spark.createDataFrame([("A", False, 0), ("B", True, 1), ("C", False, 2)], "fn string, passed boolean, ord int")
    bench = spark.createDataFrame(
        [("a", None, None, 0), ("B", None, None, 1), ("D", None, "x", 2), ("E", 1.0, None, 3)],
        "fn string, cand_ms double, error string, ord int",
    )
    gone = spark.createDataFrame([("c",)], "fn string")
    assert rows(triage.retry_set(acc, bench, gone)) == [("a", 0, 0), ("b", 1, 1)]
    tries = spark.createDataFrame([("a", 0, "x"), ("a", 5, "y"), ("b", 1, "z")], "fn string, attempt int, note string")
    assert rows(triage.attempt_ledger(tries, ["note"])) == [("a", "y", 3), ("b", "z", 1)]


def test_first_wins(spark, rows):
    df = spark.createDataFrame([("Ab", 2, "x"), ("aB", 1, "y"), ("c", 3, "z")], "k string, ord int, v string")
    assert rows(selection.dedupe_lower(df, "k", "ord")) == [("ab", 1, "y"), ("c", 3, "z")]
    cand = spark.createDataFrame(
        [("f", 1, "m1", 100, True), ("f", 2, "m2", 101, True), ("g", 0, "cache", 5, False), ("h", 1, "m1", 3, True)],
        "name string, priority int, origin string, bytes long, downloaded boolean",
    )
    found = selection.resolve_sources(cand)
    assert rows(found) == [("f", 2, "m2", 101), ("g", 0, "cache", 5)]
    assert rows(selection.missing_sources(cand.select("name"), found)) == [("h",)]


def test_chat_folding(spark, rows):
    turns = spark.createDataFrame(
        [
            (1, 0, "system", "s1"), (1, 1, "tool", "t"), (1, 2, "assistant", "a"), (1, 3, "system", "s2"), (1, 4, "user", ""),
            (2, 0, "system", "only"), (3, 0, "user", ""), (3, 1, None, "x"),
        ],
        "conv_id long, turn long, role string, text string",
    )
    assert rows(chat.fold_conversation(turns)) == [(1, "s1\n\ns2", 2, 1), (2, "only", 1, 1), (3, None, 1, 1)]
    assert (2, None, "user", "Continue.") in rows(chat.fold_messages(turns))
    deltas = spark.createDataFrame(
        [(1, 2, "b", "text"), (1, 1, "a", "text"), (1, 3, "p", "ping"), (1, 4, "", "text"), (1, 5, "c", "text")],
        "m int, n int, text string, kind string",
    )
    assert rows(chat.assemble_chunks(deltas, ["m"], "n", "text", "kind")) == [(1, "abc")]


def test_value_files(spark, rows):
    data = [("c1", 0, 0, 0.1), ("c1", 1, 0, 2.5), ("c1", 1, 1, -1e-300), ("c2", 0, 0, 7.0)]
    df = spark.createDataFrame(data, "case string, arg_ord int, pos long, v double").repartition(3)
    for limit in (5_000_000, 1):
        path = scratch_path(spark, "values")
        IO.write_values(df, path, ["case"], lines_per_file=limit)
        back = IO.read_values(spark, path, "*.txt").withColumn("case", F.regexp_extract("file", "case=([^/]+)", 1))
        got = back.orderBy("case", "pos").select("case", "pos", "v").collect()
        assert [tuple(r) for r in got] == [("c1", 0, 0.1), ("c1", 1, 2.5), ("c1", 2, -1e-300), ("c2", 0, 7.0)]
        assert back.select("file").distinct().count() == 2


def test_long_cases_fill_their_files_and_keep_their_order(spark):
    # sparse positions in files of 2 lines, over 1,000 files in a task
    counts = {"a b": 1_030, "c=1": 5}
    data = [(case, arg, 7 * p, float(10_000 * arg + p)) for case, n in counts.items() for arg in range(2) for p in range(n)]
    data += [("s", 1, 0, 5.0), ("s", 0, 1, 4.0), ("s", 0, 0, 3.0)]
    df = spark.createDataFrame(data, "case string, arg_ord int, pos long, v double").repartition(5)
    path = scratch_path(spark, "values")
    IO.write_values(df, path, ["case"], lines_per_file=2)
    sizes = [tuple(r) for r in spark.read.text(path).groupBy(F.input_file_name()).count().collect()]
    # no file has more lines than asked for; only the last of a case in a task may have fewer
    assert max(n for _, n in sizes) == 2 and sum(n == 1 for _, n in sizes) <= 12
    assert any(".c1000." in name for name, _ in sizes)
    back = IO.read_values(spark, path, "*.txt")
    texts = back.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("x")).collect()
    got = sorted([tuple(x) for x in r["x"]] for r in texts)
    want = [[10_000.0 * arg + p for arg in range(2) for p in range(n)] for n in counts.values()] + [[3.0, 4.0, 5.0]]
    assert got == sorted(list(enumerate(w)) for w in want)
    scans = back._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("FileScan text")
    assert scans == 2


def test_files_of_a_folder_stand_in_the_order_of_their_names(spark, tmp_path):
    for name in ("part-2-x.c10.txt", "part-10-x.c2.txt", "part-2-x.c9.txt", "z.txt", "a.txt"):
        (tmp_path / name).write_text(name + "\n")
    got = [r["line"] for r in IO.read_lines(spark, str(tmp_path), by_folder=True).orderBy("ln").collect()]
    assert got == ["a.txt", "part-10-x.c2.txt", "part-2-x.c10.txt", "part-2-x.c9.txt", "z.txt"]


def test_value_lines_with_odd_white_space(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b" 1.5\t\r\n\x0b \n\n2\x0c3\x0b\x0b 4 \n\x1e\xc2\x855\n inf \n")
    (tmp_path / "b.txt").write_bytes(b"1\n\xc2\xa0\n2\n")
    (tmp_path / "c.txt").write_bytes(b"\n \n")
    got = sorted((r["file"][-5:], -1 if r["pos"] is None else r["pos"], r["v"]) for r in IO.read_values(spark, str(tmp_path)).collect())
    assert got == [*[("a.txt", k, v) for k, v in enumerate([1.5, 2.0, 3.0, 4.0, 5.0, float("inf")])], ("b.txt", -1, None)]


def test_a_bad_line_voids_every_piece_of_its_case(spark):
    data = [("c1", 0, p, float(p)) for p in range(7)] + [("c2", 0, p, float(p)) for p in range(4)]
    df = spark.createDataFrame(data, "case string, arg_ord int, pos long, v double")
    df = df.withColumn("v", F.when((F.col("case") == "c1") & (F.col("pos") == 4), "T").otherwise(F.col("v").cast("string")))
    path = scratch_path(spark, "values")
    IO.write_values(df, path, ["case"], lines_per_file=3)
    back = IO.read_values(spark, path, "*.txt").withColumn("case", F.regexp_extract("file", "case=([^/]+)", 1))
    got = sorted((r["case"], -1 if r["pos"] is None else r["pos"], r["v"]) for r in back.collect())
    assert got == [("c1", -1, None), *[("c2", p, float(p)) for p in range(4)]]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path, small_splits):
    rng = random.Random(6)
    numbers = [round(rng.uniform(-9, 9), rng.randrange(12)) for _ in range(9_000)]
    blanks = ["", "  ", "\t"]
    lines = [x for n in numbers for x in [f" {n} ", *rng.sample(blanks, rng.choice([0, 0, 1]))]]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    (tmp_path / "b.txt").write_text("1\r\n2\x0b3\r4\n")
    (tmp_path / "c.txt").write_text("\n".join([*map(str, range(5_000)), "T", *map(str, range(5_000))]))
    (tmp_path / "d.txt").write_text("")
    back = IO.read_values(spark, str(tmp_path), "*.txt").withColumn("f", F.regexp_extract("file", "([a-z]).txt$", 1))
    assert IO._split_lines(spark, str(tmp_path), "a.txt").rdd.getNumPartitions() > 8
    got = {}
    for r in back.collect():
        got.setdefault(r["f"], {})[r["pos"]] = r["v"]
    assert got["a"] == {n: float(v) for n, v in enumerate(numbers)}
    assert got["b"] == {0: 1.0, 1: 2.0, 2: 3.0, 3: 4.0}
    assert got["c"] == {None: None} and set(got) == {"a", "b", "c"}


def test_line_numbers_run_through_the_splits(spark, tmp_path, small_splits):
    rng = random.Random(7)
    texts = {n: [" " * rng.randrange(3) + f"{n}{i}" * rng.randrange(4) for i in range(3_000)] for n in "xy"}
    for n, lines in texts.items():
        (tmp_path / f"{n}.f").write_text("\n".join(lines) + "\n")
    got = {}
    for r in IO.read_lines(spark, str(tmp_path), "*.f").collect():
        got.setdefault(r["doc"][-3], {})[r["ln"]] = r["line"]
    assert got == {n: dict(enumerate(lines, 1)) for n, lines in texts.items()}
    (tmp_path / "z.g").write_bytes(b"ok \xff end\n\nlast")
    rows = IO.read_lines(spark, str(tmp_path), "*.g").orderBy("ln").collect()
    assert [(r["ln"], r["line"]) for r in rows] == [(1, "ok \ufffd end"), (2, ""), (3, "last")]


def test_null_message_lists_lose_nothing(spark):
    row = [("f", None, ["bad"], "note")]
    df = spark.createDataFrame(row, "fn string, warnings array<string>, compiler_errors array<string>, error string")
    assert [(r["kind"], r["message"]) for r in report.flatten_messages(df).collect()] == [("compiler_error", "bad"), ("note", "note")]


def test_selection_numbers_of_any_length(spark):
    from sparkrecon.operators.selection import parse_selection

    df = spark.createDataFrame([("99999999999",), ("-3",), ("0",), ("002",), ("dot",)], "raw string")
    sizes = [len(r[0]) for r in df.select(parse_selection(F.col("raw"), ["A", "B", "C"])).collect()]
    assert sizes == [3, 1, 1, 2, 1]


def test_tab_indented_declarations(spark, rows):
    text = "      SUBROUTINE T(N, X)\n\tINTEGER\tN\n\tREAL X(\tN )\n      END\n"
    units = corpus.units(one(spark, text))
    got = corpus.declarations(corpus.unit_header(units)).orderBy("arg_ord").collect()
    assert [(r["arg"], r["ftype"], r["dims"]) for r in got] == [("N", "INTEGER", []), ("X", "REAL", ["N"])]


def _split_by_hand(text):
    items, depth, now = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            items.append(now)
            now = ""
        else:
            now += c
    return [*items, now]


def test_commas_inside_parentheses_do_not_cut(spark):
    rng = random.Random(8)
    texts = ["", ",", "A", "X(MAX(1,N),*)", "A(1),B(2,(3,4)),C", "A),B,(C", "((A,B", "A)(,B)(,C"]
    texts += ["".join(rng.choice("AB,,() ") for _ in range(rng.randrange(30))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", split_outside(F.col("t")).alias("s"))
    for r in df.collect():
        assert r["s"] == _split_by_hand(r["t"]), r["t"]


def test_deep_and_open_parentheses_are_cut_in_linear_time(spark):
    deep = "A" + "(" * 9 + "1,2" + ")" * 9 + ",B"
    texts = [deep, "A(((((1,2))))),B", "A((((((1,2)))))),B", "A((1),B(2,3),C,D", "A,(,B),(C,(D),E", "A)B,C(D,E)", "(A,B),C),D,(E"]
    texts += [",".join(f"X{i}((1)" for i in range(400)) + ",Y(" * 20_000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", split_outside(F.col("t")).alias("s")).collect()
    for r in rows:
        assert r["s"] == _split_by_hand(r["t"]), r["t"][:50]


def test_declarations_read_a_unit_once(spark):
    rows = [
        # an argument twice, items after tabs, names that only begin like an argument, a scalar with a mark
        ("a", 0, "      INTEGER N,\tXY (2) , X(3),N2\n\tREAL X/1/ ,N", ["n", "X", "n", "X/1/"], False),
        ("a", 0, "      LOGICAL n", ["N"], False),
        (None, 0, "      INTEGER N", ["N"], False),
        ("b", 1, None, ["K"], False),
        ("c", 0, "      INTEGER N", None, False),
        ("d", 0, "      INTEGER N", [], False),
    ]
    headed = spark.createDataFrame(rows, "doc string, unit int, source string, args array<string>, whole boolean")
    found = corpus.declarations(headed)
    got = sorted(((r["doc"] or "", r["unit"], r["arg_ord"], r["arg"], r["ftype"], r["dims"]) for r in found.collect()), key=repr)
    assert got == sorted(
        [
            ("a", 0, 0, "N", "REAL", []), ("a", 0, 0, "N", "REAL", []), ("a", 0, 2, "N", "REAL", []),
            ("a", 0, 1, "X", "INTEGER", ["3"]), ("a", 0, 3, "X/1/", "REAL", []),
            # a unit without a name takes no declarations
            ("", 0, 0, "N", "DOUBLE PRECISION", []), ("b", 1, 0, "K", "DOUBLE PRECISION", []),
        ],
        key=repr,
    )
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Scan") == 1 and "Join" not in plan


def test_declarations_with_nested_dimensions(spark):
    text = (
        "      SUBROUTINE T(N, X, Y, Z, L, W)\n\tINTEGER N , X ( MAX(1,N) , * ),Y\n      REAL Z((2,3),A(4)), Y(N,\n"
        "     $   2)\n      LOGICAL L(N),, W (2)\n      END\n"
    )
    got = corpus.declarations(corpus.unit_header(corpus.units(one(spark, text)))).orderBy("arg_ord").collect()
    assert [(r["arg"], r["ftype"], r["dims"]) for r in got] == [
        ("N", "INTEGER", []),
        # dimensions reach to the first closing parenthesis
        ("X", "INTEGER", ["MAX(1", "N"]),
        # an item whose parentheses stay open on its line declares no argument
        ("Y", "INTEGER", []),
        ("Z", "REAL", ["(2", "3"]),
        ("L", "LOGICAL", ["N"]),
        ("W", "LOGICAL", ["2"]),
    ]


def test_a_bad_line_voids_the_file(spark, rows):
    files = spark.createDataFrame([("a", "1.5\n\n 2e3 \n"), ("b", "1\nT\n2"), ("c", "")], "k string, t string")
    assert rows(IO.parse_values(files, "k", "t")) == [("a", 0, 1.5), ("a", 1, 2000.0), ("b", None, None)]


def test_corpus_reader_replaces_bad_bytes(spark, tmp_path):
    (tmp_path / "x.f").write_bytes(b"ok \xff end\n")
    (tmp_path / "y.txt").write_text("no")
    got = IO.read_corpus(spark, str(tmp_path), "*.f").collect()
    assert len(got) == 1 and got[0]["text"] == "ok � end\n"


def test_report_files_are_in_order(spark):
    lines = report.render_rows(spark.range(20), [F.col("id").cast("string")], keep=["id"])
    path = scratch_path(spark, "report")
    IO.write_report(lines, path, ["id"])
    text = "".join(f.read_text() for f in sorted(Path(path).glob("part-*")))
    assert text.splitlines() == [f"| {n} |" for n in range(20)]
    assert IO.read_report(spark, path).count() == 20
    with pytest.raises(ValueError):
        report.render_row([F.col("id")], "pdf")


def test_chunk_bounds(spark, rows):
    lines = corpus.line_table(one(spark, "\n".join("abcdefg"))).withColumn("pos", F.col("ln") - 1)
    assert rows(corpus.chunk(lines, ["doc"], "pos", 3), "piece", "n_lines", "text") == [
        (0, 3, "a\nb\nc"), (1, 3, "d\ne\nf"), (2, 1, "g")
    ]


def test_chunk_texts_equals_chunk(spark, rows):
    texts = ["", None, "one", "a\nb\nc\n", "\n\n", "\n".join(f"line {i}" for i in range(25)), "a\r\nb\rc"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc int, text string")
    lines = corpus.line_table(docs).withColumn("pos", F.col("ln") - 1)
    for n in (1, 3, 25, 200):
        want = corpus.chunk(lines, ["doc"], "pos", n)
        got = corpus.chunk_texts(docs, ["doc"], n=n)
        assert got.dtypes == want.dtypes and rows(got) == rows(want)
        assert "Exchange" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_error_blocks_over_ranges(spark, block):
    """Blocks that go on over many ranges, empty ranges, logs without a hit, against a plain loop."""
    rng = random.Random(block)
    rows = [(f"log{g}", 3 * i if g == 1 else i, rng.choice(["", " ", "x", "y", "z"] + ["hit"] * (g > 0) * (rng.random() < 0.1))) for g in range(5) for i in range(60)]
    rows += [("long", i, "hit" if i == 40 else "x") for i in range(60)]
    want = []
    for log in {r[0] for r in rows}:
        blk, blocks, whole = 0, {}, sorted((ln, line) for g, ln, line in rows if g == log)
        for ln, line in whole:
            if not line.strip():
                blk += 1
            else:
                blocks.setdefault(blk, []).append((ln, line))
        kept = [(log, b, ln, line) for b, ls in blocks.items() if any("hit" in x for _, x in ls) for ln, line in ls]
        want += kept or [(log, None, ln, line) for ln, line in whole]
    rows.append((None, 1, "hit"))
    want.append((None, None, 1, "hit"))
    lines = spark.createDataFrame(rows, "log string, ln long, line string")
    got = logs.error_blocks(lines, F.col("line").contains("hit"), block=block).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def test_files_of_a_folder_are_numbered_as_one_text(spark, tmp_path, small_splits):
    """A text cut into files by line order keeps its numbers; no task needs to write or read it whole."""
    lines = [f"line {i}" if i % 5 else "" for i in range(4_000)]
    for name, part in (("part-00000", lines[:1_500]), ("part-00001", lines[1_500:1_501]), ("part-00002", lines[1_501:])):
        (tmp_path / "k=1").mkdir(exist_ok=True)
        (tmp_path / "k=1" / f"{name}.txt").write_text("\n".join(part) + "\n")
    (tmp_path / "k=2").mkdir()
    (tmp_path / "k=2" / "part-00001.txt").write_text("other\n")
    got = {}
    for r in IO.read_lines(spark, str(tmp_path), "*.txt", by_folder=True).collect():
        got.setdefault(r["doc"][-3:], {})[r["ln"]] = r["line"]
    assert got == {"k=1": dict(enumerate(lines, 1)), "k=2": {1: "other"}}
