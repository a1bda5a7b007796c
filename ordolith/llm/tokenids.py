"""Operator 9: token ids as Arrow files of equal-length sequences, with zero-copy random access.

``write_token_files`` encodes texts and writes, for every shard, one Arrow IPC file whose record batches hold
``ids: fixed_size_list<uint16|uint32>[L]`` and ``mask: fixed_size_list<bool>[L]`` (true: a token, false: padding of
the shard's last sequence), and beside it a small index file ``doc_id, start, n_tokens``. Shards follow ascending
id, and so do the rows in a shard, so a document's global position is its shard's offset plus its start.

Nulls: a null text is an empty text (one end token); a null id sorts first. Ties: rows under one id, or under none, are in
the order of a hash of their text and may span shards, so files don't depend on the order of the input. Repeated rows
are written as often as they occur. An empty table gives no shards. Columns other than id and text are not read. A
text of any length is held whole, with its ids.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Memo, arrow_schema, held, scratch_path, stored, table, text_key

END = 2
WORDS_FILE = "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Letters that composition leaves alone and that have one lower-case letter each, then marks: two pieces to either tokenizer.
LETTERS_MARKS = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ſ]+)([!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]*)")


def byte_characters() -> list[str]:
    """The printable character that byte-level tokenizers write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Pieces:
    """Ids of text without inner white space. Letters and marks skip the tokenizer's normaliser and splitter, whose
    outcome is known for them, and go to its merging model; anything else is encoded by the tokenizer."""

    def __init__(self, path: str, code: str, lower: bool):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        model, chars = tok.model, byte_characters()
        self.whole = lambda s: array(code, tok.encode(s, add_special_tokens=False).ids).tobytes()
        mapped = lambda s: s.replace(" ", chars[32]) if s.isascii() else "".join([chars[b] for b in s.encode()])
        self.ids = lambda s: array(code, [t.id for t in model.tokenize(mapped(s))]).tobytes()
        self.marks = Memo(self.ids, 20_000)
        self.lower = lower

    def __call__(self, word: str, letters_of: Callable[[str], bytes], space: str = "") -> bytes:
        """letters_of: the ids of the letters alone, from the caller's memo, which holds them for other marks."""
        m = LETTERS_MARKS.fullmatch(word)
        if not m:
            return self.whole(space + word)
        letters, marks = m.groups()
        return letters_of(letters) + self.marks[marks] if marks else self.ids(space + (letters.lower() if self.lower else letters))


class WordEncoder:
    """Ids of texts under a tokenizer that drops white space: the concatenation of the ids of the text's words.

    ASCII white space never takes part in the tokenizer's composition (NFC), lower-casing or splitting rules,
    so words can be encoded one by one and remembered.
    """

    def __init__(self, path: str, code: str):
        pieces = Pieces(path, code, lower=True)
        self.memo = Memo(lambda w: pieces(w.decode(), lambda letters: self.memo[letters.encode()]), 200_000)
        self.end = array(code, [END]).tobytes()

    def __call__(self, text: str | None) -> bytes:
        return b"".join(map(self.memo.__getitem__, (text or "").encode().split())) + self.end


def word_encoder(path: str, code: str) -> WordEncoder:
    """One encoder a process: Spark reuses Python workers, and the memo stays warm between tasks."""
    return held(f"words {code} {path}", lambda: WordEncoder(path, code))


#: Hadoop's names of stores that pyarrow calls otherwise.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "gcs": "gs"}


def open_fs(uri: str):
    """pyarrow's file system for a Hadoop-style URI, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), uri.removeprefix("file:").replace("//", "/", 1) if uri.startswith("file://") else uri.removeprefix("file:")
    scheme, mark, rest = uri.partition("://")
    return fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + mark + rest) if mark else (fs.LocalFileSystem(), uri)


def publish(filesystem, at: str, final: str) -> None:
    """Put a finished file in its place; a repeated task writes the same bytes, so the last one may win."""
    filesystem.move(at, final)


class ShardWriter:
    """Streams ids into fixed-size batches: memory is one batch, whatever the shard's size."""

    def __init__(self, folder: str, shard: int, length: int, wide: bool, batch: int = 256):
        from pyspark import TaskContext

        self.fs, root = open_fs(folder)
        self.fs.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
        self.final = f"{root}/shard-{shard:06d}.arrow"
        self.temp = f"{root}/.shard-{shard:06d}-{attempt}.tmp"
        self.length, self.rows, self.dtype = length, batch, np.dtype("<u4" if wide else "<u2")
        value = pa.uint32() if wide else pa.uint16()
        self.schema = pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.fs.open_output_stream(self.temp)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[bytes] = []
        self.size = self.n = 0
        self.value = value
        self.index: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        k = len(ids) // self.dtype.itemsize
        self.index.append((doc_id, self.n, k))
        self.held.append(ids)
        self.size += k
        self.n += k
        if self.size >= self.length * self.rows:
            self.flush(False)

    def flush(self, last: bool) -> None:
        flat = np.frombuffer(b"".join(self.held), self.dtype)
        keep = len(flat)
        if last:
            flat = np.concatenate([flat, np.zeros(-keep % self.length, self.dtype)])
        step = self.length if last else self.length * self.rows  # all batches but the last have equally many rows
        full = len(flat) // step * step
        rest = flat[full:]
        for lo in range(0, full, self.length * self.rows):
            part = flat[lo : min(lo + self.length * self.rows, full)]
            mask = np.arange(lo, lo + len(part)) < keep
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x, t), self.length) for x, t in ((part, self.value), (mask, pa.bool_()))]
            self.out.write_batch(pa.record_batch(lists, schema=self.schema))
        self.held, self.size = [rest.tobytes()], len(rest)

    def close(self) -> int:
        self.flush(True)
        self.out.close()
        self.sink.close()
        publish(self.fs, self.temp, self.final)
        ids, starts, counts = zip(*self.index) if self.index else ((), (), ())
        index = pa.table({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(counts, pa.int64())})
        at = self.temp + ".idx"
        with self.fs.open_output_stream(at) as sink, pa.ipc.new_file(sink, index.schema) as out:
            out.write_table(index, max_chunksize=65536)
        publish(self.fs, at, self.final.replace(".arrow", ".idx"))
        return self.n


class TokenFile:
    """Random access to one shard. On a local disk the file is memory-mapped and sequences are views of it."""

    def __init__(self, folder: str, shard: int):
        filesystem, root = open_fs(folder)
        at = f"{root}/shard-{shard:06d}"
        local = type(filesystem).__name__ == "LocalFileSystem"
        self.source = pa.memory_map(f"{at}.arrow") if local else filesystem.open_input_file(f"{at}.arrow")
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        with filesystem.open_input_file(f"{at}.idx") as f:
            self.index = pa.ipc.open_file(f).read_all()
        self.batches = self.reader.num_record_batches
        self.rows = self.reader.get_batch(0).num_rows if self.batches else 0
        self.held: tuple[int, np.ndarray] = (-1, np.empty(0))

    def batch_ids(self, b: int) -> np.ndarray:
        if self.held[0] != b:
            self.held = b, self.reader.get_batch(b).column(0).values.to_numpy(zero_copy_only=True)
        return self.held[1]

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k-th sequence and its mask."""
        b, r = divmod(k, self.rows)
        batch = self.reader.get_batch(b)
        ids = batch.column(0).values.to_numpy(zero_copy_only=True)
        mask = batch.column(1).values.slice(r * self.length, self.length).to_numpy(zero_copy_only=False)
        return ids[r * self.length : (r + 1) * self.length], mask

    def tokens(self, start: int, n: int) -> np.ndarray:
        """Ids ``start .. start + n`` of the shard: a view if they lie in one batch."""
        per, parts = self.rows * self.length, []
        while n > 0:
            b, at = divmod(start, per)
            part = self.batch_ids(b)[at : at + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint16)


def write_token_files(docs: DataFrame, folder: str, path: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, shards: int | None = None, wide: bool = False) -> DataFrame:
    """Write shards to ``folder``; returns the manifest (shard int, n_tokens long), stored in the shared folder.

    One range shuffle by id and text hash, the only one that an ascending order needs; encoding follows it, so ids are not
    shuffled. Texts of a shard stream through: memory is one batch of texts and one of sequences.
    """
    code = "I" if wide else "H"
    n = shards or max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = arrow_schema(docs.sparkSession, "shard int, n_tokens bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encode, out = word_encoder(path, code), None
        for batch in batches:
            for i in range(batch.num_rows):
                out = out or ShardWriter(folder, shard, length, wide)
                out.add(batch.column(0)[i].as_py(), encode(batch.column(1)[i].as_py()))
        if out:
            yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([out.close()], pa.int64())], schema=schema)

    text = F.col(text_col)
    picked = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), text_key(text).alias("tie"))
    ordered = picked.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    return stored(ordered.mapInArrow(run, "shard int, n_tokens bigint"), "token-manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Read shards back: doc_id, start (global), n_tokens, ids_crc32 (over little-endian unsigned 32-bit ids)."""
    spark = manifest.sparkSession
    schema = "shard int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"
    out = arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                f = TokenFile(folder, shard)
                for part in f.index.to_batches(max_chunksize=8192):
                    ids, starts, counts = (c.to_pylist() for c in part.columns)
                    crc = [zlib.crc32(f.tokens(s, k).astype("<u4").tobytes()) for s, k in zip(starts, counts)]
                    yield pa.record_batch([pa.array([shard] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], schema=out)

    # one row a shard: a bounded, tiny window, and a task for every few shards
    offsets = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = manifest.select("shard").repartition(n, "shard").mapInArrow(run, schema)
    # said outright, as the optimizer takes the rows, whose estimate is the manifest's, for the small side
    return rows.join(F.broadcast(offsets.select("shard", "before")), "shard").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    docs = table(spark, sf_dir, "documents")
    manifest = write_token_files(docs, folder, tokenizer_path(WORDS_FILE))
    return read_token_files(manifest, folder)
