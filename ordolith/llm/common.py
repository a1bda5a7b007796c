"""Shared pieces of the corpus operators: scratch tables, word memos, numpy hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  slices() uses pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs without ASCII white space; ``bytes.split()`` splits on exactly \x20 \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (local tests) a folder of our own is made,
    and the session is told.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = held.get() if held.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="ordolith-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/ordolith/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs only a re-read."""
    at = scratch_path(df.sparkSession, what)
    df.write.parquet(at)
    back = df.sparkSession.read.schema(df.schema).parquet(at)
    back.stored_at = at
    return back


def drop_stored(*frames: DataFrame) -> None:
    """Delete the files of frames from ``stored`` that nothing reads any more (a frame derived from one still does)."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        folder = sc._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def text_key(text: Column) -> Column:
    """With the id it names a row by content, so that rows that share an id, or have none, are judged apart.

    A null text has the key of an empty one, as all operators treat them alike.
    """
    return F.xxhash64(F.coalesce(text, F.lit("")))


def anti_join(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose (id, text key) isn't in ``gone`` (doc_id, tie); null ids are equal. All columns as they were."""
    gone = gone.select(F.col("doc_id").alias("_gone_id"), F.col("tie").alias("_gone_tie")).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_gone_id"]) & (text_key(docs[text_col]) == gone["_gone_tie"]), "left_anti")


def free(name: str, taken: Iterable[str]) -> str:
    """``name``, or a longer one that no column has."""
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name


_HELD: dict = {}


def held(name: str, make: Callable):
    """What a worker keeps between tasks (a memo, an encoder): of one operator at a time, as workers outlive the stages."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


class Memo(dict):
    """Bounded two-generation cache of ``f``: at ``limit`` entries the young generation becomes the old one.

    ``map(memo.__getitem__, words)`` runs at C speed for words seen lately, and
    memory stays below two generations whatever the vocabulary.
    """

    def __init__(self, f: Callable, limit: int = 250_000):
        super().__init__()
        self.f, self.limit, self.old = f, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.f(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def map_docs(df: DataFrame, schema: str, make: Callable[[], Callable], columns: Iterable[str]) -> DataFrame:
    """Arrow-batched map: ``make()`` runs once a task and gives ``f(*column lists) -> columns`` for each slice.

    Slices hold a bounded number of characters (beyond the largest single row), so memory does not follow the
    batch size.
    """
    columns = list(columns)
    out = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            for lo, hi in slices(cols, batch.num_rows):
                got = f(*(c.slice(lo, hi - lo).to_pylist() for c in cols))
                yield pa.record_batch([pa.array(v, t) for v, t in zip(got, out.types)], schema=out)

    return df.select(*columns).mapInArrow(run, schema)


def slices(cols, n: int, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Row ranges whose string and binary cells add up to about ``most`` bytes at most."""
    size = np.full(n, 16, np.int64)
    for c in cols:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
            size += np.asarray(pa.compute.fill_null(pa.compute.binary_length(c), 0), np.int64)
    group = np.cumsum(size) // most
    edges = np.flatnonzero(np.diff(group)) + 1
    ends = [0, *edges.tolist(), n]
    return ((a, b) for a, b in zip(ends, ends[1:]) if b > a)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


M1, M2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (two multiply-xorshift rounds)."""
    x = (x ^ (x >> np.uint64(32))) * M1
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


def word_hash(word: bytes) -> int:
    """A 64-bit hash of a word that every process computes alike."""
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-word windows of word hashes ``h``; empty when there are fewer words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = mix(h[:n])
    for i in range(1, k):
        x = mix(x * np.uint64(3) + h[i : i + n])
    return x


def map_groups(df: DataFrame, key: str, f: Callable, schema: str, unique: str | None = None) -> DataFrame:
    """Rows of equal ``key`` (a bigint) go to ``f(key, columns)``, columns as lists without the key; f gives rows.

    For groups whose size is bounded by what made them. One shuffle by key, a spilling sort, and runs of equal keys read
    in Arrow batches: many small groups cost no call into pandas each. unique: a bigint column of which a group holds
    each value once; further rows pass by unheld.
    """
    out = arrow_schema(df.sparkSession, schema)
    order = [key, unique] if unique else [key]
    names = [*order, *(c for c in df.columns if c not in order)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, last = None, [[] for _ in names[1:]], None
        rows: list = []

        def flush():
            batch = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), out.types)], schema=out)
            rows.clear()
            return batch

        for batch in batches:
            if unique and batch.num_rows:
                pair = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
                new = np.r_[last is None or (pair[:, 0] != last).any(), (pair[:, 1:] != pair[:, :-1]).any(0)]
                last, batch = pair[:, -1].copy(), batch.filter(pa.array(new))
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            cols = [c.to_pylist() for c in batch.columns[1:]]
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for lo, hi in zip(edges, edges[1:]):
                if hi == lo:
                    continue
                if held_key is not None and keys[lo] != held_key:
                    rows += f(held_key, held)
                    held = [[] for _ in names[1:]]
                held_key = int(keys[lo])
                for h, c in zip(held, cols):
                    h += c[lo:hi]
                if len(rows) > 50_000:
                    yield flush()
        if held_key is not None:
            rows += f(held_key, held)
        if rows:
            yield flush()

    return df.select(*names).repartition(key).sortWithinPartitions(*order).mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that links ``a``-``b`` reach, for every id in a link.

    Alternating large-star and small-star steps; each round is written to the shared folder, so lineage stays short. A
    round's aggregates combine before the shuffle, and its joins may be split where one id has very many links.
    """
    spark = edges.sparkSession
    links = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")

    def star(links: DataFrame, large: bool) -> DataFrame:
        both = links.union(links.select(F.col("b"), F.col("a"))) if large else links
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        met = both.join(least, both["a"] == least["u"])
        if large:  # larger neighbours of u go to the least of its neighbourhood
            return met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        return met.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(least.select("u", "m")).distinct()

    def done(links: DataFrame) -> bool:
        """Whether every larger id has one link, and the smaller ids have none of their own: one combined count by id."""
        ends = links.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("b", F.lit(0), F.lit(1)))
        return not ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").limit(1).count()

    while not done(links):
        half = stored(star(links, True), "links")
        new = stored(star(half, False), "links")
        drop_stored(links, half)
        links = new
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).union(links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
