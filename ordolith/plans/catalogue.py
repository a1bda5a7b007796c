"""Every operator as a query over the fixture tables, with the same result in ANSI SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..algorithms import graphs, learning, selection, strings
from ..frame import OrderedFrame, ordered
from ..functions.text import line_number, run_lengths, words
from ..functions.vectors import doubles
from ..operators import actions, arrange, joins, keep, keyed, local, scans, windows, zips
from ..sources import arrays, files
from ..store import fresh_path, stored
from ..streaming.windows import windowed_reduce

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> OrderedFrame:
    return ordered(table(spark, sf, "events"), "event_id")


CENTS = "CAST(round(value * 100) AS BIGINT)"


def cents() -> Column:
    return arrays.scaled(F.col("value"))


# Sources


@query("SELECT range AS idx FROM range(1000)")
def generate(spark, sf):
    return arrays.generate(spark, 1000).df


@query("SELECT range AS idx, range * range AS square FROM range(1000)")
def generate_map(spark, sf):
    return arrays.generate(spark, 1000, square=F.col("idx") * F.col("idx")).df


@query("SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'b', CAST(3 AS BIGINT)), (1, 'a', 1), (2, 'c', 2)) t(idx, name, n)")
def distribute(spark, sf):
    return arrays.distribute(spark, [("b", 3), ("a", 1), ("c", 2)], "name string, n bigint").df


@query("SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'b'), (1, 'a'), (2, 'c'), (3, 'z')) t(idx, name)")
def concat_to(spark, sf):
    return arrays.concat_to(spark, [[("b",), ("a",)], [], [("c",), ("z",)]], "name string").df.transform(lambda d: ordered(d, "source", "idx").with_index("place").df.select(F.col("place").alias("idx"), "name"))


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey >= 1")
def read_table(spark, sf):
    return local.filter_rows(arrays.read_table(spark, f"{sf}/region.parquet", "r_regionkey"), F.col("r_regionkey") >= 1).df


def _names(spark, sf):
    return ordered(table(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey")


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS idx, n_name AS value FROM nation")
def read_lines(spark, sf):
    at = fresh_path(spark, "lines")
    files.write_lines_one(_names(spark, sf), at, "n_name")
    return files.read_lines(spark, at).with_index().df.select("idx", "value")


@query("SELECT n_name AS value FROM nation")
def read_gz(spark, sf):
    at = fresh_path(spark, "gz")
    files.write_lines(_names(spark, sf).df, at, "n_name", compression="gzip")
    return files.read_lines(spark, at).df.select("value")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS value FROM orders WHERE o_orderkey % 3 < 2")
def read_glob(spark, sf):
    at, o = fresh_path(spark, "globs"), table(spark, sf, "orders")
    for i, name in enumerate(("in-0", "in-1", "out-0")):
        files.write_lines(o.where(F.col("o_orderkey") % 3 == i), f"{at}/{name}", "o_orderkey", compression="bzip2" if i else "none")
    return files.read_lines(spark, f"{at}/in-*").df.select("value")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS value FROM orders")
def write_lines(spark, sf):
    at = fresh_path(spark, "lines")
    files.write_lines(table(spark, sf, "orders"), at, "o_orderkey", rows_per_file=4000)
    return files.read_lines(spark, at).df.select("value")


@query("SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS idx, CAST(o_orderkey AS VARCHAR) AS value FROM orders")
def write_one(spark, sf):
    at = fresh_path(spark, "one")
    files.write_lines_one(ordered(table(spark, sf, "orders"), "-o_totalprice", "o_orderkey"), at, "o_orderkey")
    return files.read_lines(spark, at).with_index().df.select("idx", "value")


@query("SELECT event_id, user_id, event_type, value FROM events")
def write_read_binary(spark, sf):
    at = fresh_path(spark, "binary")
    files.write_binary(events(spark, sf).df.select("event_id", "user_id", "event_type", "value"), at)
    return files.read_binary(spark, at, "event_id").df


# Local operators


@query("SELECT event_id, round(value * 2, 2) AS doubled FROM events")
def map(spark, sf):  # noqa: A001
    return local.map_rows(events(spark, sf), "event_id", F.round(F.col("value") * 2, 2).alias("doubled")).df


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error'")
def filter(spark, sf):  # noqa: A001
    return local.filter_rows(events(spark, sf), F.col("event_type") == "error").df.select("event_id", "user_id")


@query("SELECT doc_id, CAST(i - 1 AS BIGINT) AS emitted, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))")
def flat_map(spark, sf):
    docs = ordered(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return local.flat_map(docs, F.split("text", " ", -1), "word").df.select("doc_id", "emitted", "word")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error')")
def union_all(spark, sf):
    e = events(spark, sf).df.select("event_id", "event_type")
    return local.union_all(e.where("event_type = 'error'"), e.where("event_type in ('click', 'error')"))


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS differing FROM events")
def cache(spark, sf):
    """Random values that are cached are drawn once: all readers see the same."""
    drawn = keep.cache(local.map_rows(events(spark, sf), "event_id", F.rand().alias("r")))
    again = keep.cache(drawn).df.withColumnRenamed("r", "s")
    return drawn.df.join(again, "event_id", "full").agg(F.count("*").alias("n"), F.count(F.when(~F.col("r").eqNullSafe(F.col("s")), 1)).alias("differing"))


@query(f"SELECT event_id, {CENTS} * 32 + 31 AS v FROM events")
def cached_loop(spark, sf):
    """Five rounds of one step; each is cached, and the one before it is given up."""
    f = keep.cache(local.map_rows(events(spark, sf), "event_id", cents().alias("v")))
    for _ in range(5):
        before, f = f, keep.cache(local.map_rows(f, "event_id", (F.col("v") * 2 + 1).alias("v")))
        keep.dispose(before)
    return f.df


@query("SELECT event_id FROM events WHERE (event_id * 7919) % 100 < 10")
def bernoulli(spark, sf):
    return local.hash_sample(events(spark, sf), F.col("event_id"), 100, 10).df.select("event_id")


@query()
def bernoulli_random(spark, sf):
    return local.bernoulli_sample(events(spark, sf), 0.1).df.select("event_id")


@query()
def sample(spark, sf):
    return actions.sample(events(spark, sf).df.select("event_id", "user_id"), 100)


# Keyed


@query(f"""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS BIGINT) AS sum_qty,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS sum_price, min(l_discount) AS min_discount, max(l_tax) AS max_tax
    FROM lineitem GROUP BY 1, 2""")
def reduce_by_key(spark, sf):
    aggs = {"n": F.count("*"), "sum_qty": ("sum", arrays.scaled(F.col("l_quantity"))), "sum_price": ("sum", arrays.scaled(F.col("l_extendedprice"))), "min_discount": ("min", "l_discount"), "max_tax": ("max", "l_tax")}
    return keyed.reduce_by_key(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], aggs)


@query("SELECT CAST(floor(o_totalprice / 1000) AS BIGINT) AS bucket, count(*) AS n, max(o_orderkey) AS last_key FROM orders GROUP BY 1")
def reduce_volatile(spark, sf):
    return keyed.reduce_by_key(table(spark, sf, "orders"), [F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("bucket")], {"n": F.count("*"), "last_key": ("max", "o_orderkey")})


@query("SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM lineitem GROUP BY 1")
def reduce_pair(spark, sf):
    pairs = table(spark, sf, "lineitem").select("l_partkey", F.col("l_quantity").cast("bigint").alias("qty"))
    return keyed.reduce_pair(pairs, "l_partkey", "qty", "sum")


def _user_slots(e: DataFrame) -> int:
    """Slots of an index by ``user_id``: every id of the events and 50 beyond."""
    most = e.agg(F.max("user_id")).first()[0]
    return (-1 if most is None else most) + 51


SLOTS = "range((SELECT coalesce(max(user_id), -1) + 51 FROM events))"


@query(f"""SELECT range AS user_id, coalesce(n, 0) AS n, coalesce(total, 0) AS total FROM {SLOTS} LEFT JOIN
    (SELECT user_id, count(*) AS n, CAST(sum({CENTS}) AS BIGINT) AS total FROM events GROUP BY 1) ON range = user_id""")
def reduce_to_index(spark, sf):
    e = events(spark, sf).df.where("user_id is not null")
    return keyed.reduce_to_index(e, "user_id", _user_slots(e), {"n": F.count("*"), "total": ("sum", cents())}, {"n": 0, "total": 0}).df


def _slots(df: DataFrame, key: Column) -> int:
    most = df.agg(F.max(key)).first()[0]
    return 0 if most is None else most + 1


@query("""SELECT range AS bucket, coalesce(n, 0) AS n, coalesce(last_key, -1) AS last_key FROM range((SELECT coalesce(max(CAST(floor(o_totalprice / 1000) AS BIGINT)), -1) + 1 FROM orders)) LEFT JOIN
    (SELECT CAST(floor(o_totalprice / 1000) AS BIGINT) AS b, count(*) AS n, max(o_orderkey) AS last_key FROM orders GROUP BY 1) ON range = b""")
def reduce_to_index_volatile(spark, sf):
    o = table(spark, sf, "orders").select(F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("bucket"), "o_orderkey")
    return keyed.reduce_to_index(o, "bucket", _slots(o, F.col("bucket")), {"n": F.count("*"), "last_key": ("max", "o_orderkey")}, {"n": 0, "last_key": -1}).df


@query(f"""SELECT range AS event_id, coalesce(v, 0) AS v FROM range((SELECT coalesce(max(event_id), -1) + 1 FROM events)) LEFT JOIN
    (SELECT event_id, CAST(sum({CENTS}) AS BIGINT) AS v FROM events GROUP BY 1) ON range = event_id""")
def reduce_to_index_unique(spark, sf):
    """Almost every key is its own: combining before the shuffle saves nothing, and Spark gives it up by itself."""
    e = events(spark, sf).df.select("event_id", cents().alias("v"))
    return keyed.reduce_to_index(e, "event_id", _slots(e, F.col("event_id")), {"v": ("sum", "v")}, {"v": 0}).df


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, max(l_partkey) AS part FROM lineitem GROUP BY 1, 2")
def reduce_unique_keys(spark, sf):
    return keyed.reduce_by_key(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], {"n": F.count("*"), "part": ("max", "l_partkey")})


@query("SELECT o_orderpriority, count(*) AS n, list(o_orderkey ORDER BY o_orderdate, o_orderkey)[1] AS first_key, list(o_orderkey ORDER BY o_orderdate, o_orderkey)[-1] AS last_key FROM orders GROUP BY 1")
def group_by_key(spark, sf):
    o = ordered(table(spark, sf, "orders"), "o_orderdate", "o_orderkey")
    items = F.col("items")
    return keyed.group_by_key(o, ["o_orderpriority"], {"n": F.size(items).cast("bigint"), "first_key": items[0]["o_orderkey"], "last_key": F.element_at(items, -1)["o_orderkey"]})


@query(f"SELECT g, v[CAST(greatest(len(v) // 2, 1) AS BIGINT)] AS median FROM (SELECT event_id % 100 AS g, list({CENTS} ORDER BY {CENTS}) AS v FROM events GROUP BY 1)")
def group_median(spark, sf):
    return keyed.group_median(events(spark, sf).df.select((F.col("event_id") % 100).alias("g"), cents().alias("v")), "g", "v")


@query(f"""SELECT range AS user_id, coalesce(last_value, -1) AS last_value FROM {SLOTS} LEFT JOIN
    (SELECT user_id, arg_max({CENTS}, event_id) AS last_value FROM events GROUP BY 1) ON range = user_id""")
def group_to_index(spark, sf):
    e = ordered(events(spark, sf).df.where("user_id is not null").select("event_id", "user_id", cents().alias("v")), "event_id")
    return keyed.group_to_index(e, "user_id", _user_slots(e.df), {"last_value": F.element_at("items", -1)["v"]}, {"last_value": -1}, "v").df


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct_via_reduce(spark, sf):
    return keyed.reduce_by_key(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"], {"n": F.count("*")}).drop("n")


# Whole-frame reductions


@query("SELECT count(*) AS size FROM events")
def size(spark, sf):
    return actions.size(events(spark, sf).df)


@query(f"SELECT CAST(42 + sum({CENTS}) AS BIGINT) AS total FROM events")
def sum(spark, sf):  # noqa: A001
    return actions.all_reduce(events(spark, sf).df, cents(), "sum", "total", 42)


@query("SELECT least(min(o_totalprice), 1e9) AS least, greatest(max(o_totalprice), 0.5) AS most FROM orders")
def min_max(spark, sf):
    o = table(spark, sf, "orders")
    return actions.all_reduce(o, "o_totalprice", "min", "least", 1e9).crossJoin(actions.all_reduce(o, "o_totalprice", "max", "most", 0.5))


@query(f"SELECT max({CENTS}) AS most FROM events")
def all_reduce(spark, sf):
    return actions.all_reduce(events(spark, sf).df, cents(), "max", "most")


@query("SELECT string_agg(n_name, '>' ORDER BY n_nationkey) AS folded FROM nation")
def ordered_fold(spark, sf):
    return actions.ordered_fold(_names(spark, sf), "n_name", F.lit(None).cast("string"), lambda a, x: F.concat_ws(">", a, x), "folded")


@query("SELECT p AS precision, n AS exact, true AS within FROM (SELECT count(DISTINCT (l_orderkey, l_partkey, l_suppkey)) AS n FROM lineitem), (VALUES (4), (8), (12), (16)) t(p)")
def hll(spark, sf):
    """At every precision the estimate is within three standard errors (1.04 / sqrt(2 ** p)) of the exact number."""
    li = table(spark, sf, "lineitem").select(F.struct("l_orderkey", "l_partkey", "l_suppkey").alias("k"))
    exact = li.agg(F.countDistinct("k").alias("exact"))
    value, parts = F.xxhash64("k"), None
    for p in (4, 8, 12, 16):
        near = F.abs(F.col("distinct") - F.col("exact")) <= 3 * 1.04 / 2 ** (p / 2) * F.col("exact")
        one = actions.hyper_log_log(li, value, p).crossJoin(exact).select(F.lit(p).alias("precision"), "exact", near.alias("within"))
        parts = one if parts is None else parts.union(one)
    return parts


@query("SELECT row_number() OVER (ORDER BY n_name, n_nationkey) - 1 AS idx, n_name AS value FROM nation")
def gather(spark, sf):
    rows = actions.gather(ordered(table(spark, sf, "nation").select("n_name", "n_nationkey"), "n_name", "n_nationkey"))
    return spark.createDataFrame([(i, r.n_name) for i, r in enumerate(rows)], "idx bigint, value string")


@query("SELECT c_custkey, n_name FROM customer JOIN (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS idx, n_name FROM nation) ON idx = c_nationkey")
def all_gather(spark, sf):
    every = actions.all_gather(_names(spark, sf), "n_name")
    return table(spark, sf, "customer").crossJoin(every).select("c_custkey", F.get("items", F.col("c_nationkey").cast("int"))["n_name"].alias("n_name"))


# Joins


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, o_custkey, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def inner_join(spark, sf):
    return joins.inner_join(table(spark, sf, "lineitem"), table(spark, sf, "orders"), ["l_orderkey"], ["o_orderkey"], "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "o_custkey", "o_orderstatus")


@query("SELECT n_name, c_custkey FROM nation JOIN customer ON n_nationkey = c_nationkey")
def inner_join_types(spark, sf):
    return joins.inner_join(table(spark, sf, "nation"), table(spark, sf, "customer"), ["n_nationkey"], ["c_nationkey"], "n_name", "c_custkey")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1998-07-01' AND o_orderdate < TIMESTAMP '1998-10-01'")
def inner_join_semi_reduced(spark, sf):
    return joins.semi_reduced_join(table(spark, sf, "lineitem"), _quarter(spark, sf), ["l_orderkey"], ["o_orderkey"], "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "o_orderpriority")


def _quarter(spark, sf):
    return table(spark, sf, "orders").where("o_orderdate >= timestamp_ntz '1998-07-01' and o_orderdate < timestamp_ntz '1998-10-01'")


LATE = "FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1998-07-01' AND o_orderdate < TIMESTAMP '1998-10-01' AND l_shipdate > o_orderdate"


@query(f"SELECT count(*) AS n {LATE}")
def tpch_q4_join(spark, sf):
    joined = joins.inner_join(_quarter(spark, sf), table(spark, sf, "lineitem"), ["o_orderkey"], ["l_orderkey"])
    return joined.where("l_shipdate > o_orderdate").agg(F.count("*").alias("n"))


@query("""SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01' AND o_orderdate < TIMESTAMP '1998-10-01'
    AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY 1""")
def tpch_q4(spark, sf):
    o, li = _quarter(spark, sf), table(spark, sf, "lineitem")
    late = o.join(li, (o["o_orderkey"] == li["l_orderkey"]) & (li["l_shipdate"] > o["o_orderdate"]), "left_semi")
    return keyed.reduce_by_key(late, ["o_orderpriority"], {"n": F.count("*")})


# Positions


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS idx FROM orders")
def zip_with_index(spark, sf):
    return ordered(table(spark, sf, "orders"), "-o_totalprice", "o_orderkey").with_index().df.select("o_orderkey", "idx")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS idx FROM orders")
def zip_with_index_two_levels(spark, sf):
    return ordered(table(spark, sf, "orders"), "-o_totalprice", "o_orderkey").with_index(one_task_bytes=-1).df.select("o_orderkey", "idx")


BY_ID = f"SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, {CENTS} AS a FROM events"
BY_TS = f"SELECT row_number() OVER (ORDER BY ts) - 1 AS idx, {CENTS} AS b FROM events"
BY_USER = "SELECT row_number() OVER (ORDER BY user_id, event_id) - 1 AS idx, user_id AS c FROM events"


def _by_id(spark, sf):
    return ordered(events(spark, sf).df.select("event_id", cents().alias("a")), "event_id"), ["a"]


def _by_ts(spark, sf):
    return ordered(events(spark, sf).df.select("ts", cents().alias("b")), "ts"), ["b"]


@query(f"SELECT idx, a, b FROM ({BY_ID}) JOIN ({BY_TS}) USING (idx)")
def zip(spark, sf):  # noqa: A001
    return zips.zip_frames([_by_id(spark, sf), _by_ts(spark, sf)]).df


@query(f"SELECT event_id, {CENTS} AS v, upper(event_type) AS kind FROM events")
def zip_aligned(spark, sf):
    return zips.zip_aligned(events(spark, sf), {"v": cents()}, {"kind": F.upper("event_type")}).df


@query(f"SELECT idx, a, b, c FROM ({BY_ID}) JOIN ({BY_TS}) USING (idx) JOIN ({BY_USER}) USING (idx)")
def zip_three(spark, sf):
    third = ordered(events(spark, sf).df.select("user_id", "event_id", F.col("user_id").alias("c")), "user_id", "event_id")
    return zips.zip_frames([_by_id(spark, sf), _by_ts(spark, sf), (third, ["c"])]).df


NATIONS = "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS idx, n_name FROM nation"
REGIONS = "SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS idx, r_name, r_regionkey FROM region"


def _two(spark, sf):
    return [(_names(spark, sf), ["n_name"]), (ordered(table(spark, sf, "region"), "r_regionkey"), ["r_name", "r_regionkey"])]


@query(f"SELECT idx, n_name, r_name, r_regionkey FROM ({NATIONS}) JOIN ({REGIONS}) USING (idx)")
def zip_cut(spark, sf):
    return zips.zip_frames(_two(spark, sf), "cut").df


@query(f"SELECT idx, n_name, coalesce(r_name, '') AS r_name, coalesce(r_regionkey, 0) AS r_regionkey FROM ({NATIONS}) LEFT JOIN ({REGIONS}) USING (idx)")
def zip_pad(spark, sf):
    return zips.zip_frames(_two(spark, sf), "pad").df


@query(f"SELECT idx, n_name, coalesce(r_name, 'none') AS r_name, coalesce(r_regionkey, -1) AS r_regionkey FROM ({NATIONS}) LEFT JOIN ({REGIONS}) USING (idx)")
def zip_pad_value(spark, sf):
    return zips.zip_frames(_two(spark, sf), "pad", {"r_name": "none", "r_regionkey": -1}).df


def _ranges(spark, n, m):
    a = arrays.generate(spark, n, a=F.col("idx") + 0)
    b = arrays.generate(spark, m, b=F.col("idx") + 0)
    return [(OrderedFrame(a.df, a.order, "idx"), "a", 2), (OrderedFrame(b.df, b.order, "idx"), "b", 3)]


def _total(df):
    add = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return df.select("block", (add("a") + 10 * add("b")).alias("v"))


@query("SELECT range AS block, (4 * range + 1) + 10 * (9 * range + 3) AS v FROM range(1000)")
def zip_window(spark, sf):
    return _total(zips.zip_windows(_ranges(spark, 2000, 3000)).df)


@query("SELECT range AS block, (4 * range + 1) + 10 * (9 * range + 3) AS v FROM range(99)")
def zip_window_cut(spark, sf):
    return _total(zips.zip_windows(_ranges(spark, 2000, 299), "cut").df)


@query("""SELECT range AS block, (4 * range + 1) + 10 * (CASE WHEN range < 99 THEN 9 * range + 3 WHEN range = 99 THEN 297 + 298 + 7 ELSE 21 END) AS v FROM range(1000)""")
def zip_window_pad(spark, sf):
    return _total(zips.zip_windows(_ranges(spark, 2000, 299), "pad", {"b": 7}).df)


def _moving(bound: str) -> str:
    return f"SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, CAST(sum({CENTS}) OVER w AS BIGINT) AS total, count(*) OVER w AS n FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND {bound} FOLLOWING)"


def _added(name="items"):
    return F.aggregate(name, F.lit(0).cast("bigint"), lambda s, x: s + x)


@query(f"SELECT idx, total FROM ({_moving('9')}) WHERE n = 10")
def window(spark, sf):
    return windows.window(events(spark, sf), 10, cents()).df.select("idx", _added().alias("total"))


@query(f"SELECT idx, total, n FROM ({_moving('9')})")
def window_partial(spark, sf):
    return windows.window(events(spark, sf), 10, cents(), partial=True).df.select("idx", _added().alias("total"), F.size("items").cast("bigint").alias("n"))


@query(f"SELECT idx, CAST(0 AS BIGINT) AS emitted, b - a AS item FROM (SELECT row_number() OVER w - 1 AS idx, {CENTS} AS a, lead({CENTS}) OVER w AS b FROM events WINDOW w AS (ORDER BY event_id)) WHERE b > a")
def flat_window(spark, sf):
    return windows.flat_window(events(spark, sf), 2, cents(), lambda x: F.filter(F.array(x[1] - x[0]), lambda d: d > 0)).df


@query(f"SELECT (i // 100) * 100 AS idx, CAST(sum(v) AS BIGINT) AS total, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, {CENTS} AS v FROM events) GROUP BY 1")
def window_disjoint(spark, sf):
    return windows.reduced_blocks(events(spark, sf), 100, {"total": F.sum(cents()), "n": F.count("*")}).df


@query(f"SELECT (i // 64) * 64 AS idx, CAST(0 AS BIGINT) AS emitted, max(v) AS item FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, {CENTS} AS v FROM events) GROUP BY 1")
def flat_window_disjoint(spark, sf):
    return windows.flat_disjoint_window(events(spark, sf), 64, cents(), lambda x: F.array(F.array_max(x))).df


@query(f"SELECT event_id, CAST(42 + sum({CENTS}) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM events")
def prefix_sum(spark, sf):
    return scans.prefix_sum(events(spark, sf), cents(), "total", initial=42).df.select("event_id", "total")


@query(f"SELECT event_id, CAST(42 + sum({CENTS}) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM events")
def prefix_sum_two_levels(spark, sf):
    return scans.prefix_sum(events(spark, sf), cents(), "total", initial=42, one_task_bytes=-1, bucket_rows=1000).df.select("event_id", "total")


@query(f"SELECT event_id, CAST(42 + coalesce(sum({CENTS}) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS total FROM events")
def ex_prefix_sum(spark, sf):
    return scans.ex_prefix_sum(events(spark, sf), cents(), "total", initial=42).df.select("event_id", "total")


@query(f"SELECT event_id, max({CENTS}) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS most FROM events")
def prefix_max(spark, sf):
    return scans.prefix_sum(events(spark, sf), cents(), "most", "max").df.select("event_id", "most")


# Order


LINE = "l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query(f"SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY {LINE}) - 1 AS idx FROM lineitem")
def sort(spark, sf):
    first, *ties = LINE.split(", ")
    return arrange.sort(table(spark, sf, "lineitem"), first, ties=tuple(ties)).with_index().df.select("l_orderkey", "l_linenumber", "l_extendedprice", "idx")


@query("SELECT event_id, row_number() OVER (ORDER BY event_type, ts) - 1 AS idx FROM events")
def sort_stable(spark, sf):
    return arrange.sort_stable(ordered(table(spark, sf, "events"), "ts"), "event_type").with_index().df.select("event_id", "idx")


@query("SELECT event_id, row_number() OVER (ORDER BY event_id % 16 DESC, event_id) - 1 AS idx FROM events")
def sort_custom(spark, sf):
    e = events(spark, sf).df.withColumn("low", F.col("event_id").bitwiseAND(F.lit(15).cast("bigint")))
    return arrange.sort(e, "-low", "event_id").with_index().df.select("event_id", "idx")


@query("""SELECT source, event_id, row_number() OVER (ORDER BY user_id, event_id, source) - 1 AS idx FROM
    (SELECT 0 AS source, * FROM events WHERE event_type = 'error' UNION ALL SELECT 1 AS source, * FROM events WHERE event_type IN ('click', 'error'))""")
def merge(spark, sf):
    e = table(spark, sf, "events")
    a, b = (ordered(e.where(c), "user_id", "event_id") for c in ("event_type = 'error'", "event_type in ('click', 'error')"))
    return arrange.merge(a, b).with_index().df.select("source", "event_id", "idx")


@query("""SELECT source, event_id, row_number() OVER (ORDER BY source, event_id) - 1 AS idx FROM
    (SELECT 0 AS source, * FROM events WHERE event_type = 'error' UNION ALL SELECT 1 AS source, * FROM events WHERE event_type = 'click')""")
def concat(spark, sf):
    e = events(spark, sf)
    return arrange.concat(local.filter_rows(e, "event_type = 'error'"), local.filter_rows(e, "event_type = 'click'")).with_index().df.select("source", "event_id", "idx")


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS idx FROM events")
def rebalance(spark, sf):
    return arrange.rebalance(events(spark, sf), 4).with_index().df.select("event_id", "idx")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top_k(spark, sf):
    return arrange.top_k(ordered(table(spark, sf, "orders"), "-o_totalprice", "o_orderkey"), 50).df.select("o_orderkey", "o_totalprice")


# Algorithms


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY 1")
def word_count(spark, sf):
    docs = table(spark, sf, "documents").select(F.explode(words(F.col("text"))).alias("word"))
    return keyed.reduce_by_key(docs, ["word"], {"n": F.count("*")})


@query(r"SELECT CAST(sum(len(string_split(text, chr(10)))) - sum(CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END) AS BIGINT) AS lines FROM documents")
def line_count(spark, sf):
    return table(spark, sf, "documents").agg(F.sum(line_number(F.col("text")).cast("bigint")).alias("lines"))


def _edges(spark, sf):
    e = events(spark, sf).with_index().df.select("idx", F.col("user_id").alias("src"))
    nxt = e.select((F.col("idx") - 1).alias("idx"), F.col("src").alias("dst"))
    return e.join(nxt, "idx").select("src", "dst")


EDGES = "edges AS (SELECT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY event_id) AS dst FROM events) WHERE dst IS NOT NULL)"


def _rank_sql(dense: bool, rounds: int = 10) -> str:
    pages = "pages AS (SELECT DISTINCT user_id AS page FROM events)"
    parts = [EDGES, pages, "deg AS (SELECT src, count(*) AS d FROM edges GROUP BY 1)", "n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM pages)", "r0 AS (SELECT page, 1.0 / n AS rank FROM pages, n)"]
    for i in range(rounds):
        given = f"SELECT dst, sum(rank / d) AS g FROM edges JOIN deg USING (src) JOIN r{i} ON page = src GROUP BY 1"
        if dense:
            parts.append(f"r{i + 1} AS (SELECT page, 0.15 / n + 0.85 * coalesce(g, 0) AS rank FROM pages CROSS JOIN n LEFT JOIN ({given}) ON page = dst)")
        else:
            parts.append(f"r{i + 1} AS (SELECT dst AS page, 0.15 / n + 0.85 * g AS rank FROM ({given}) CROSS JOIN n)")
    return f"WITH {', '.join(parts)} SELECT page, round(rank, 8) AS rank FROM r{rounds}"


@query(_rank_sql(True))
def page_rank(spark, sf):
    pages = table(spark, sf, "events").select(F.col("user_id").alias("page")).distinct()
    return graphs.page_rank(pages, _edges(spark, sf), 10).select("page", F.round("rank", 8).alias("rank"))


@query(_rank_sql(False))
def page_rank_join(spark, sf):
    pages = table(spark, sf, "events").select(F.col("user_id").alias("page")).distinct()
    return graphs.page_rank_linked(pages, _edges(spark, sf), 10).select("page", F.round("rank", 8).alias("rank"))


@query(f"WITH {EDGES}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst) SELECT count(*) AS triangles FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b")
def triangles(spark, sf):
    return graphs.triangles(graphs.undirected(_edges(spark, sf)))


#: No path without a circle is longer than there are nodes.
LEVELS = f"""{EDGES}, r(node, level) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT dst, level + 1 FROM r JOIN edges ON src = node WHERE level < least(64, (SELECT count(DISTINCT src) FROM edges))),
    levels AS (SELECT node, min(level) AS level FROM r GROUP BY 1)"""


@query(f"WITH RECURSIVE {LEVELS} SELECT node, level FROM levels")
def bfs_levels(spark, sf):
    return graphs.bfs_levels(_edges(spark, sf), 0)


@query(f"WITH RECURSIVE {LEVELS} SELECT b.node, min(a.node) AS parent FROM edges JOIN levels a ON a.node = src JOIN levels b ON b.node = dst AND b.level = a.level + 1 GROUP BY 1")
def bfs_forest(spark, sf):
    e = _edges(spark, sf)
    return graphs.bfs_parents(e, graphs.bfs_levels(e, 0))


@query()  # trees depend on those before: tests compare it with a search by hand
def bfs_trees(spark, sf):
    nodes = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("node"))
    links = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("src"), F.explode(F.expr("array(bigint(n_regionkey + 5), bigint(n_nationkey * 2))")).alias("dst"))
    return graphs.bfs_trees(nodes, links)


@query()  # random
def zipf_graph(spark, sf):
    return graphs.zipf_graph(spark, 2000).groupBy("dst").agg(F.count("*").alias("n"))


@query("SELECT o_totalprice FROM orders ORDER BY o_totalprice LIMIT 1 OFFSET 777")
def select_rank(spark, sf):
    return selection.select_rank(table(spark, sf, "orders"), "o_totalprice", 777, keep=500)


def _centers(spark, sf):
    rows = learning.means(table(spark, sf, "embeddings"), "label", "embedding").orderBy("label").collect()  # one a label
    return [(r.label, list(r.center)) for r in rows]


CENTERS = "centers AS (SELECT label AS c, list(m ORDER BY i) AS center FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1)"
DISTANCES = "d AS (SELECT vec_id, c, list_sum(list_transform(range(1, 65), lambda i: (CAST(embedding[i] AS DOUBLE) - center[i]) * (CAST(embedding[i] AS DOUBLE) - center[i]))) AS dist FROM embeddings, centers)"


@query(f"WITH {CENTERS}, {DISTANCES} SELECT cluster, count(*) AS n FROM (SELECT vec_id, CAST(arg_min(c, round(dist, 9)) AS BIGINT) AS cluster FROM d GROUP BY 1) GROUP BY 1")
def kmeans_step(spark, sf):
    near = learning.nearest(table(spark, sf, "embeddings"), "embedding", _centers(spark, sf))
    return keyed.reduce_by_key(near, ["cluster"], {"n": F.count("*")})


@query(f"WITH {CENTERS}, {DISTANCES} SELECT round(sum(dist), 4) AS cost FROM (SELECT vec_id, min(dist) AS dist FROM d GROUP BY 1)")
def kmeans_cost(spark, sf):
    return learning.kmeans_cost(table(spark, sf, "embeddings"), "embedding", _centers(spark, sf)).select(F.round("cost", 4).alias("cost"))


@query()
def bisecting_kmeans(spark, sf):
    e = table(spark, sf, "embeddings")
    return learning.nearest(e, "embedding", learning.bisecting_kmeans(e, "embedding", 4)).groupBy("cluster").agg(F.count("*").alias("n"))


def _labelled(spark, sf):
    return joins.inner_join(table(spark, sf, "labels"), table(spark, sf, "documents").withColumnRenamed("doc_id", "id"), ["doc_id"], ["id"]).select((F.col("n_chars") / 10000).alias("x"), F.col("quality").cast("double").alias("y"))


LABELLED = "FROM (SELECT n_chars / 10000 AS x, CAST(quality AS DOUBLE) AS y FROM labels JOIN documents USING (doc_id))"


@query(f"SELECT round(0.1 - 0.5 * sum(1 / (1 + exp(-(0.1 + 0.2 * x))) - y) / count(*), 6) AS w0, round(0.2 - 0.5 * sum((1 / (1 + exp(-(0.1 + 0.2 * x))) - y) * x) / count(*), 6) AS w1 {LABELLED}")
def logreg_step(spark, sf):
    step = learning.logistic_step(_labelled(spark, sf), [F.lit(1.0), F.col("x")], F.col("y"), [0.1, 0.2], 0.5)
    return step.select(F.round("w0", 6).alias("w0"), F.round("w1", 6).alias("w1"))


@query(f"SELECT round(0.1 - 0.05 * sum((0.1 + 0.2 * x) - y) / count(*), 6) AS w0, round(0.2 - 0.05 * sum(((0.1 + 0.2 * x) - y) * x) / count(*), 6) AS w1 {LABELLED}")
def sgd_step(spark, sf):
    step = learning.least_squares_step(_labelled(spark, sf), [F.lit(1.0), F.col("x")], F.col("y"), [0.1, 0.2], 0.05)
    return step.select(F.round("w0", 6).alias("w0"), F.round("w1", 6).alias("w1"))


def _descent_sql(steps: int = 4) -> str:
    """Step i takes a fourth of the rows at rate 0.05 / sqrt(i)."""
    parts = ["d AS (SELECT doc_id, n_chars / 10000 AS x, CAST(quality AS DOUBLE) AS y FROM labels JOIN documents USING (doc_id))", "w0 AS (SELECT 0.1::DOUBLE AS a, 0.2::DOUBLE AS b)"]
    for i in range(1, steps + 1):
        parts.append(f"w{i} AS (SELECT any_value(a) - 0.05 / sqrt({i}) * avg(a + b * x - y) AS a, any_value(b) - 0.05 / sqrt({i}) * avg((a + b * x - y) * x) AS b FROM w{i - 1}, d WHERE doc_id % {steps} = {i % steps})")
    return f"WITH {', '.join(parts)} SELECT round(a, 6) AS w0, round(b, 6) AS w1 FROM w{steps}"


@query(_descent_sql())
def sgd_batches(spark, sf):
    rows = joins.inner_join(table(spark, sf, "labels"), table(spark, sf, "documents").withColumnRenamed("doc_id", "id"), ["doc_id"], ["id"]).select("doc_id", (F.col("n_chars") / 10000).alias("x"), F.col("quality").cast("double").alias("y"))
    w = learning.mini_batch_descent(rows, [F.lit(1.0), F.col("x")], F.col("y"), [0.1, 0.2], 0.05, [F.col("doc_id") % 4 == i % 4 for i in range(1, 5)])
    return spark.createDataFrame([tuple(round(x, 6) for x in w)], "w0 double, w1 double")


RECORD = "concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT), l_returnflag)"


@query(f"SELECT key, line, row_number() OVER (ORDER BY key, line) - 1 AS idx FROM (SELECT substr(md5({RECORD}), 1, 20) AS key, {RECORD} AS line FROM lineitem)")
def terasort(spark, sf):
    """100-byte records (key of 10, value of 90) are written, read, sorted, written and read, all as binary files."""
    line = F.expr(RECORD)
    rows = table(spark, sf, "lineitem").select(F.concat(F.unhex(F.md5(line).substr(1, 20)), F.encode(F.rpad(line, 90, " "), "UTF-8")).alias("record"))
    raw, done = fresh_path(spark, "records"), fresh_path(spark, "sorted-records")
    files.write_records(rows, raw, "record", 100)
    files.write_records(ordered(files.read_records(spark, raw, 100), "record").sorted(), done, "record", 100, file_bytes=4 << 20)
    back = ordered(files.read_records(spark, done, 100), "record").with_index().df
    return back.select(F.lower(F.hex(F.substring("record", 1, 10))).alias("key"), F.rtrim(F.decode(F.substring("record", 11, 90), "UTF-8")).alias("line"), "idx")


#: The suffix algorithms take the whole benchmark table as one text.
WHOLE = "t AS (SELECT string_agg(text || chr(10), '' ORDER BY item_id) AS t FROM benchmark)"
SUFFIXES = f"{WHOLE}, sa AS (SELECT row_number() OVER (ORDER BY encode(substr(t, CAST(i + 1 AS BIGINT)))) - 1 AS rank, i, t FROM t, range((SELECT length(t) FROM t)) r(i))"


def _text(spark, sf):
    return strings.joined(table(spark, sf, "benchmark"), "text", "item_id")


@query(f"WITH {SUFFIXES} SELECT rank, i FROM sa")
def suffix_array(spark, sf):
    return strings.suffix_array(_text(spark, sf))


@query(f"""WITH {SUFFIXES}, n AS (SELECT rank, i, encode(substr(t, CAST(i + 1 AS BIGINT))) AS s, lead(encode(substr(t, CAST(i + 1 AS BIGINT)))) OVER (ORDER BY rank) AS after FROM sa)
    SELECT count(*) AS n, bool_and(coalesce(s < after, true)) AS ok, CAST(sum(i * rank) % 1000003 AS BIGINT) AS digest, false AS swapped_ok FROM n""")
def suffix_array_check(spark, sf):
    """The check accepts the suffix array and rejects it with two neighbours swapped."""
    text = _text(spark, sf)
    sa = stored(strings.suffix_array(text), "suffix-array")
    swapped = sa.withColumn("rank", F.when(F.col("rank") == 7, 8).when(F.col("rank") == 8, 7).otherwise(F.col("rank")).cast("bigint"))
    facts = sa.agg(F.count("*").alias("n"), (F.sum(F.col("i") * F.col("rank")) % 1000003).alias("digest"))
    return facts.crossJoin(strings.is_suffix_array(text, sa)).crossJoin(strings.is_suffix_array(text, swapped).withColumnRenamed("ok", "swapped_ok"))


@query(f"WITH {SUFFIXES} SELECT rank, CASE WHEN i = 0 THEN substr(t, -1, 1) ELSE substr(t, CAST(i AS BIGINT), 1) END AS c FROM sa")
def bwt(spark, sf):
    text = _text(spark, sf)
    return strings.burrows_wheeler(text, strings.suffix_array(text))


@query()  # quadratic in SQL: tests compare it with brute force
def lcp(spark, sf):
    return strings.longest_common_prefixes(_text(spark, sf))


@query(f"WITH {WHOLE}, s AS (SELECT i, CAST(unicode(substr(t, CAST(i + 1 AS BIGINT), 1)) AS BIGINT) AS code FROM t, range((SELECT length(t) FROM t)) r(i)) SELECT row_number() OVER (ORDER BY code // 64, i) - 1 AS place, (code // 32) % 2 AS bit FROM s")
def wavelet_level(spark, sf):
    return strings.wavelet_level(_text(spark, sf), 8, 2)


@query("""WITH b AS (SELECT event_type, event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events),
    c AS (SELECT *, i // 256 AS block, CASE WHEN i % 256 = 0 OR event_type <> lag(event_type) OVER (ORDER BY i) THEN 1 ELSE 0 END AS s FROM b),
    d AS (SELECT *, sum(s) OVER (ORDER BY i) AS run FROM c),
    e AS (SELECT block, run, event_type AS symbol, count(*) AS length FROM d GROUP BY 1, 2, 3)
    SELECT block * 256 AS idx, row_number() OVER (PARTITION BY block ORDER BY run) - 1 AS emitted, symbol, length FROM e""")
def rle_blocks(spark, sf):
    runs = windows.flat_disjoint_window(events(spark, sf), 256, "event_type", run_lengths, "run").df
    return runs.select("idx", "emitted", F.col("run.symbol").alias("symbol"), F.col("run.length").alias("length"))


# Extras around the joins


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01' AND o_orderdate < TIMESTAMP '1998-10-01') ON c_custkey = o_custkey GROUP BY 1")
def ext_left_outer(spark, sf):
    return joins.outer_join(table(spark, sf, "customer"), _quarter(spark, sf), ["c_custkey"], ["o_custkey"]).groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01' AND o_orderdate < TIMESTAMP '1998-10-01')")
def ext_semi(spark, sf):
    return joins.outer_join(table(spark, sf, "customer"), _quarter(spark, sf), ["c_custkey"], ["o_custkey"], "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01' AND o_orderdate < TIMESTAMP '1998-10-01')")
def ext_anti(spark, sf):
    return joins.outer_join(table(spark, sf, "customer"), _quarter(spark, sf), ["c_custkey"], ["o_custkey"], "left_anti").select("c_custkey")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup(spark, sf):
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def ext_intersect(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf, "supplier").select("s_nationkey"))


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01' AND o_orderdate < TIMESTAMP '1998-10-01'")
def ext_except(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).subtract(_quarter(spark, sf).select("o_custkey"))


@query(f"""SELECT c.event_id, c.user_id, p.v AS v FROM (SELECT * FROM events WHERE event_type = 'click') c
    ASOF LEFT JOIN (SELECT user_id, ts, {CENTS} AS v FROM events WHERE event_type = 'purchase') p ON c.user_id = p.user_id AND c.ts >= p.ts""")
def ext_asof(spark, sf):
    e = table(spark, sf, "events")
    clicks = e.where("event_type = 'click'").select("user_id", "ts", "event_id")
    buys = e.where("event_type = 'purchase'").select("user_id", "ts", cents().alias("v"))
    return joins.as_of_join(clicks, buys, "ts", ["user_id"], "v", "event_id").select("event_id", "user_id", "v")


@query(f"SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, CAST(sum({CENTS}) AS BIGINT) AS total FROM events GROUP BY 1, 2")
def ext_windowed(spark, sf):
    e = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = windowed_reduce(e, "at", "1 hour", "10 minutes", ["event_type"], {"n": F.count("*"), "total": F.sum(cents())})
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS norm FROM embeddings")
def vector_norm(spark, sf):
    from ..functions.vectors import dot

    v = doubles(F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(dot(v, v), 6).alias("norm"))
