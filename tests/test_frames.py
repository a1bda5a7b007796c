"""Order, positions, windows, zips and scans: edge cases, errors, and independence of the partitioning."""

import itertools
import math

import pytest
from ordolith.algorithms import graphs, learning, strings
from ordolith.frame import estimated_bytes, ordered
from ordolith.functions.text import run_lengths
from ordolith.operators import actions, arrange, joins, keep, keyed, local, scans, windows, zips
from ordolith.sources import arrays, files
from pyspark.sql import functions as F

ROWS = [(i, (i * 37) % 11 - 5 if i % 13 else None, "ab"[i % 2]) for i in range(83)]


def frame(spark, rows=ROWS, parts=1):
    return ordered(spark.createDataFrame(rows, "k bigint, v bigint, s string").repartition(parts), "k")


def values(f, name):
    return [r[name] for r in f.sorted().collect()]


@pytest.mark.parametrize("parts", [1, 3, 7])
@pytest.mark.parametrize("one_task", [0, 1 << 40])
@pytest.mark.parametrize("how", ["sum", "max", "min", "last"])
def test_scans_do_not_depend_on_the_plan(spark, parts, one_task, how):
    step = {"sum": lambda a, b: b if a is None else a if b is None else a + b, "max": lambda a, b: b if a is None else a if b is None else max(a, b), "min": lambda a, b: b if a is None else a if b is None else min(a, b), "last": lambda a, b: a if b is None else b}[how]
    want = list(itertools.accumulate([r[1] for r in ROWS], step))
    got = scans.prefix_sum(frame(spark, parts=parts), "v", "t", how, one_task_bytes=one_task, bucket_rows=10)
    assert values(got, "t") == want
    got = scans.prefix_sum(frame(spark, parts=parts), "v", "t", how, exclusive=True, one_task_bytes=one_task, bucket_rows=10)
    assert values(got, "t") == [None, *want[:-1]]


def test_scan_of_strings_and_of_nothing(spark):
    for one_task in (0, 1 << 40):
        got = scans.prefix_sum(frame(spark, ROWS[:9]), "s", "t", "concat", one_task_bytes=one_task, bucket_rows=4)
        assert values(got, "t") == list(itertools.accumulate(r[2] for r in ROWS[:9]))
        assert scans.ex_prefix_sum(frame(spark, ROWS[:0]), "v", "t", one_task_bytes=one_task).df.count() == 0


@pytest.mark.parametrize("one_task", [0, 1 << 40])
@pytest.mark.parametrize("k", [1, 4, 83, 84])
def test_windows(spark, one_task, k):
    keys = [r[0] for r in ROWS]
    how = {"one_task_bytes": one_task, "bucket_rows": 10}
    if k <= 10 or one_task:
        assert values(windows.window(frame(spark, parts=3), k, "k", **how), "items") == [keys[i : i + k] for i in range(len(keys) - k + 1)]
        assert values(windows.window(frame(spark, parts=3), k, "k", partial=True, **how), "items") == [keys[i : i + k] for i in range(len(keys))]
    assert values(windows.disjoint_window(frame(spark, parts=3), k, "k", one_task_bytes=one_task), "items") == [keys[i : i + k] for i in range(0, len(keys), k)]


@pytest.mark.parametrize("one_task", [0, 1 << 40])
def test_positions_follow_the_order(spark, one_task):
    f = ordered(frame(spark, parts=5).df, "-v", "k").with_index("i", one_task)
    want = sorted(ROWS, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r.k, r.i) for r in f.sorted().collect()] == [(r[0], i) for i, r in enumerate(want)]


def test_order_must_be_total_and_known(spark):
    with pytest.raises(ValueError, match="not total"):
        ordered(frame(spark).df, "s").check_total()
    with pytest.raises(ValueError, match="not in the frame"):
        ordered(frame(spark).df, "nope")


def test_zip_modes(spark):
    a = ordered(spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k bigint, a string"), "k")
    b = ordered(spark.createDataFrame([(1, 10), (2, 20)], "k bigint, b bigint"), "k")
    parts = [(a, ["a"]), (b, ["b"])]
    with pytest.raises(ValueError, match="equal length"):
        zips.zip_frames(parts)
    rows = lambda f: [(r.a, r.b) for r in f.sorted().collect()]
    assert rows(zips.zip_frames(parts, "cut")) == [("x", 10), (None, 20)]
    assert rows(zips.zip_frames(parts, "pad")) == [("x", 10), (None, 20), ("z", 0)]
    assert rows(zips.zip_frames(parts, "pad", {"b": 42})) == [("x", 10), (None, 20), ("z", 42)]
    with pytest.raises(ValueError, match="different names"):
        zips.zip_frames([(a, ["a"]), (a, ["a"])])
    with pytest.raises(ValueError, match="whole blocks"):
        zips.zip_windows([(a, "a", 2), (b, "b", 2)])
    blocks = zips.zip_windows([(a, "a", 2), (b, "b", 2)], "pad", {"a": "-"})
    assert [(r.a, r.b) for r in blocks.sorted().collect()] == [(["x", None], [10, 20]), (["z", "-"], [0, 0])]


def test_dense_results_fill_gaps_and_reject_keys_outside(spark):
    got = keyed.reduce_to_index(spark.createDataFrame([(1, 5), (1, 6), (3, 7)], "k bigint, v bigint"), "k", 5, {"t": ("sum", "v")}, {"t": -1})
    assert values(got, "t") == [-1, 11, -1, 7, -1]


def test_stable_sort_merge_concat(spark):
    f = frame(spark, parts=4)
    assert [r.k for r in arrange.sort_stable(f, "s").sorted().collect()] == [r[0] for r in sorted(ROWS, key=lambda r: r[2])]
    a, b = frame(spark, ROWS[:10]), frame(spark, ROWS[5:12])
    assert [r.k for r in arrange.merge(a, b).sorted().collect()] == sorted([r[0] for r in ROWS[:10] + ROWS[5:12]])
    assert [r.k for r in arrange.concat(a, b).sorted().collect()] == [r[0] for r in ROWS[:10] + ROWS[5:12]]
    assert [r.k for r in arrange.top_k(f, 3).sorted().collect()] == [0, 1, 2]


def test_folds_of_nothing_and_with_initial_values(spark):
    none = frame(spark, ROWS[:0]).df
    assert actions.all_reduce(none, "v", "sum", "t").first().t is None
    assert actions.all_reduce(none, "v", "sum", "t", 7).first().t == 7
    assert actions.all_reduce(frame(spark, ROWS, 4).df, "v", "min", "t", -9).first().t == -9
    assert actions.size(none).first()[0] == 0
    with pytest.raises(ValueError):
        actions.hyper_log_log(none, "v", 3)


def test_joins(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "x bigint, l string")
    right = spark.createDataFrame([(1, "p"), (3, "q"), (None, "r")], "y bigint, r string")
    got = joins.inner_join(left, right, ["x"], ["y"], "l", "r").collect()
    assert sorted(map(tuple, got)) == [("a", "p"), ("b", "p")]
    assert sorted(map(tuple, joins.semi_reduced_join(left, right, ["x"], ["y"], "l", "r").collect())) == sorted(map(tuple, got))
    a = spark.createDataFrame([(1, 5, 1), (1, 15, 2), (2, 9, 3)], "u bigint, t bigint, id bigint")
    b = spark.createDataFrame([(1, 5, 50), (1, 10, 100), (1, 20, 200)], "u bigint, t bigint, v bigint")
    assert sorted((r.id, r.v) for r in joins.as_of_join(a, b, "t", ["u"], "v", "id").collect()) == [(1, 50), (2, 100), (3, None)]


def test_files_round_trip(spark, tmp_path):
    lines = arrays.distribute(spark, [("x",), ("",), ("ü z",)], "line string")
    files.write_lines_one(lines, str(tmp_path / "one"), "line")
    assert [r[0] for r in files.read_lines(spark, str(tmp_path / "one")).sorted().select("value").collect()] == ["x", "", "ü z"]
    files.write_binary(frame(spark).df, str(tmp_path / "bin"))
    assert values(files.read_binary(spark, str(tmp_path / "bin"), "k"), "v") == [r[1] for r in ROWS]


def test_run_lengths(spark):
    df = spark.createDataFrame([(["a", "a", "b", "a"],), ([],)], "x array<string>").select(run_lengths(F.col("x")).alias("r"))
    assert [[(y.symbol, y.length) for y in r.r] for r in df.collect()] == [[("a", 2), ("b", 1), ("a", 1)], []]


@pytest.mark.parametrize("text", ["banana$bandana", "aaaaaaa", "x", "mississippi river"])
def test_suffix_structures(spark, text):
    t = strings.symbols(spark.createDataFrame([(text,)], "t string"), "t")
    sa = strings.suffix_array(t)
    order = sorted(range(len(text)), key=lambda i: text[i:])
    assert [r.i for r in sa.orderBy("rank").collect()] == order
    assert strings.is_suffix_array(t, sa).first().ok
    assert not strings.is_suffix_array(t, sa.withColumn("i", F.lit(0).cast("bigint"))).first().ok or len(text) == 1
    assert "".join(r.c for r in strings.burrows_wheeler(t, sa).orderBy("rank").collect()) == "".join(text[i - 1] for i in order)

    def shared(a, b):
        return next((k for k, (x, y) in enumerate(zip(text[a:], text[b:])) if x != y), min(len(text) - a, len(text) - b))

    assert [r.lcp for r in strings.longest_common_prefixes(t).orderBy("rank").collect()] == [0, *(shared(a, b) for a, b in zip(order, order[1:]))]


def test_local_operators_keep_order(spark):
    f = frame(spark, parts=3)
    assert values(local.filter_rows(f, "k % 2 = 0"), "k") == [r[0] for r in ROWS if r[0] % 2 == 0]
    items = local.flat_map(frame(spark, ROWS[:3]), F.array("k", F.col("k") * 10), "x")
    assert values(items, "x") == [0, 0, 1, 10, 2, 20]
    assert local.union_all(f.df, f.df).count() == 2 * len(ROWS)


def test_streaming_windows_with_late_rows(spark, tmp_path):
    from ordolith.streaming.windows import windowed_reduce

    rows = spark.sql("SELECT timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(id AS int)) AS at, id % 3 AS u, id AS v FROM range(200)")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    want = {tuple(r) for r in windowed_reduce(rows, "at", "1 hour", "10 minutes", ["u"], {"t": F.sum("v")}).select("start", "u", "t").collect()}
    stream = windowed_reduce(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "at", "1 hour", "10 minutes", ["u"], {"t": F.sum("v")})
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windowed").start()
    try:
        q.processAllAvailable()
        assert {tuple(r) for r in spark.table("windowed").select("start", "u", "t").collect()} == want
    finally:
        q.stop()


def test_one_file_is_written_by_all_tasks(spark, tmp_path):
    rows = [(i, f"línea {i} " + "x" * (i % 37)) for i in range(5000)]
    df = spark.createDataFrame(rows[::-1], "k bigint, line string").repartition(7)
    files.write_lines_one(ordered(df, "k"), str(tmp_path / "one"), "line")
    names = [p.name for p in (tmp_path / "one").iterdir()]
    assert names == ["part-00000.txt"] and (tmp_path / "one" / names[0]).read_text() == "".join(line + "\n" for _, line in rows)
    files.write_lines_one(ordered(df.limit(0), "k"), str(tmp_path / "none"), "line")
    assert (tmp_path / "none" / "part-00000.txt").read_bytes() == b""


def test_record_files(spark, tmp_path):
    rows = [(i.to_bytes(4, "big") + b"\n\0\xff" + bytes([i % 256]),) for i in range(1000)]
    df = spark.createDataFrame(rows, "r binary").orderBy("r").coalesce(1)
    manifest = files.write_records(df, f"file://{tmp_path}/a", "r", 8, pattern="r-@@-###.bin", file_bytes=3001)
    sizes = {r.file: r.size for r in manifest.collect()}
    assert sorted(sizes) == [f"r-00-{k:03}.bin" for k in range(3)] and [sizes[k] for k in sorted(sizes)] == [3000, 3000, 2000]
    assert b"".join((tmp_path / "a" / k).read_bytes() for k in sorted(sizes)) == b"".join(r for r, in rows)
    spark.conf.set("mapreduce.input.fileinputformat.split.maxsize", "1000")
    assert sorted(bytes(r.record) for r in files.read_records(spark, f"file://{tmp_path}/a", 8).collect()) == [r for r, in rows]
    spark.conf.unset("mapreduce.input.fileinputformat.split.maxsize")
    with pytest.raises(ValueError, match="no multiple of 7"):
        files.read_records(spark, f"file://{tmp_path}/a", 7)
    with pytest.raises(Exception, match="records of 9 bytes"):
        files.write_records(df, f"file://{tmp_path}/b", "r", 9)
    assert files.write_records(df.limit(0), f"file://{tmp_path}/c", "r", 8).count() == 0
    assert files.file_pattern("out/x", 3, 4) == "out/x00030000000004" and files.file_pattern("a@@-##.txt", 123, 5) == "a123-05.txt"


def test_group_medians(spark):
    rows = [(g, (i * 7919) % 1000) for g in range(3) for i in range(10 * g + 1)] + [(5, None), (None, 4), (None, 2)]
    df = spark.createDataFrame(rows, "g bigint, v bigint")
    want = {}
    for g in {g for g, _ in rows}:
        v = sorted(x for k, x in rows if k == g and x is not None)
        if v:
            want[g] = v[max(len(v) // 2 - 1, 0)]
    assert {r.g: r.median for r in keyed.group_median(df, "g", "v").collect()} == want


def trees_by_hand(nodes, edges):
    out = {}
    for root in sorted(nodes):
        if root in out:
            continue
        out[root], front, level = (root, 0), [root], 0
        while front:
            level += 1
            front = sorted({d for s, d in edges if s in front and d in nodes and d not in out})
            out.update({d: (root, level) for d in front})
    return out


def test_trees_and_levels_to_the_end(spark):
    edges = [(i, i + 1) for i in range(3, 15)] + [(9, 3), (20, 4), (21, 20), (20, 21), (30, 30), (1, 2), (2, 1)]
    nodes = sorted({x for e in edges for x in e} | {40})
    e = spark.createDataFrame(edges, "src bigint, dst bigint")
    n = spark.createDataFrame([(x,) for x in nodes], "node bigint")
    assert {r.node: (r.root, r.level) for r in graphs.bfs_trees(n, e).collect()} == trees_by_hand(nodes, edges)
    assert {r.node: r.level for r in graphs.bfs_levels(e, 3).collect()} == {3 + i: i for i in range(13)}
    assert {r.node: r.level for r in graphs.bfs_levels(e, 3, 2).collect()} == {3: 0, 4: 1, 5: 2}
    assert graphs.bfs_trees(n.limit(0), e).count() == 0


def test_zipf_graphs(spark):
    rows = graphs.zipf_graph(spark, 1000, mean=20.0, spread_by=2.0).cache()
    assert 18_500 < rows.count() < 21_500 and rows.where("dst < 0 or dst >= 1000").count() == 0
    into = {r.dst: r["count"] for r in rows.groupBy("dst").count().collect()}
    low, high = sum(into.get(i, 0) for i in range(10)), sum(into.get(i, 0) for i in range(900, 1000))
    assert low > 4 * high  # a hundredth of the pages against a tenth


def test_mini_batches(spark):
    rows = spark.createDataFrame([(float(i), 3.0 * i + 1, i % 3) for i in range(9)], "x double, y double, b int")
    got = learning.mini_batch_descent(rows, [F.lit(1.0), F.col("x")], F.col("y"), [0.0, 0.0], 0.01, [F.col("b") == k for k in (0, 1, 7)])
    w = [0.0, 0.0]
    for i, k in enumerate((0, 1), 1):
        mine = [(x, 3.0 * x + 1) for x in range(9) if x % 3 == k]
        e = [w[0] + w[1] * x - y for x, y in mine]
        w = [w[0] - 0.01 / i**0.5 * sum(e) / 3, w[1] - 0.01 / i**0.5 * sum(a * x for a, (x, _) in zip(e, mine)) / 3]
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(got, w))


def test_generators_count_as_large(spark):
    big = spark.range(10).select(F.explode(F.sequence(F.lit(0), F.lit(99))).alias("x"))
    assert estimated_bytes(big) > 1 << 40 and estimated_bytes(spark.range(10)) < 1 << 20
    assert sorted(r.idx for r in ordered(big, "x").with_index().df.collect()) == list(range(1000))


def test_cached_frames_are_computed_once(spark):
    f = ordered(spark.range(100).withColumn("r", F.rand()), "id").cached()
    assert f.df.collect() == f.df.collect() and "Rand" not in f.df._jdf.queryExecution().optimizedPlan().toString()


def test_cached_frames_are_kept_until_disposed_of(spark):
    f = keep.cache(frame(spark, parts=3))
    assert keep.cache(f) is f
    assert values(f, "k") == list(range(83)) and values(f, "k") == list(range(83))
    keep.execute(f, frame(spark))
    with pytest.raises(ValueError):
        keep.dispose(frame(spark))
    keep.dispose(f)
    with pytest.raises(Exception):
        f.df.collect()
    failing = local.map_rows(frame(spark), "k", F.raise_error(F.lit("run")).alias("v"))
    with pytest.raises(Exception, match="run"):
        keep.execute(failing)
    assert keep.cache(ordered(f.df.sparkSession.createDataFrame([], "k bigint"), "k")).df.count() == 0


def test_aligned_zip_shuffles_nothing(spark):
    f = frame(spark, parts=5).cached()
    z = zips.zip_aligned(f, {"twice": F.col("v") * 2}, {"big": F.upper("s")})
    assert "Exchange" not in z.df._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in z.sorted().collect()] == [(k, None if v is None else 2 * v, s.upper()) for k, v, s in ROWS]
    with pytest.raises(ValueError):
        zips.zip_aligned(f, {"x": F.col("v")}, {"x": F.col("k")})
    with pytest.raises(ValueError):
        zips.zip_aligned(f, {"k": F.col("v")})


def test_gathered_and_printed_frames_are_in_order(spark):
    import io

    f = frame(spark, parts=5)
    items = actions.all_gather(f, "v").first()["items"]
    assert [(r.k, r.v) for r in items] == [(k, v) for k, v, _ in ROWS]
    with pytest.raises(ValueError):
        actions.all_gather(f, "v", most=82)
    assert actions.all_gather(ordered(frame(spark).df.limit(0), "k"), "v").first()["items"] == []
    out = io.StringIO()
    actions.print_frame(frame(spark, ROWS[:3], 2), "three", out)
    assert out.getvalue().splitlines() == ["-- three: begin", *(f"[{k}] {k} {v} {s}" for k, v, s in ROWS[:3]), "-- three: end"]


def test_no_task_of_a_zip_gets_all_rows(spark):
    n = 600_000
    a = ordered(spark.range(n).select("id", (F.col("id") * 2).alias("a")), "id")
    b = ordered(spark.range(n).select("id", (F.col("id") + 5).alias("b")), "-id")
    c = ordered(spark.range(n).select("id", F.col("id").alias("c")), "id")
    assert 16 << 20 > estimated_bytes(a.df) > 4 << 20
    for frames in ([(a, ["a"]), (b, ["b"])], [(a, ["a"]), (b, ["b"]), (c, ["c"])]):
        parts = zips.zip_frames(frames).df.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"), F.count_if(F.expr("a = 2 * idx and b = 599999 - idx + 5")).alias("right")).collect()
        assert sum(r.n for r in parts) == sum(r.right for r in parts) == n
        assert max(r.n for r in parts) < n / 2
