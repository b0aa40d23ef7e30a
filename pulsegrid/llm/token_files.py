"""Token-ID output: ids packed at a fixed width of the fewest bits that hold the vocabulary.

A file holds, in order:

* header, 16 bytes: b"PGTOK002", then as little-endian u32 the bits of an id and the ids in a block;
* blocks of `block` ids each, the last one shorter, an id in `bits` bits, lowest bit first, a block padded to a byte;
* footer: as i64 the byte offset of each block, and of each document its doc_id (the least i64 for null), then the
  number of ids before it; last as u64 the ids and the documents in the file, and the byte offset of the footer.

All but the last block take the same number of bytes, so any run of ids is read by seeking to its blocks and
unpacking those with numpy. What is known only at the end stands at the end, so a file is written in one go. Files are numbered in ascending order of doc_id, as are the documents within each.
"""

from __future__ import annotations

import posixpath
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import json_encoder, shared_dir

MAGIC, HEADER, LAST, NULL_ID = b"PGTOK002", struct.Struct("<8sII"), struct.Struct("<QQQ"), -(2**63)
#: So many first characters of a text part rows of one doc_id among files; whole texts order them inside.
LEAD = 256


def width(vocabulary: int) -> int:
    """The fewest bits that hold the ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    by_id = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(by_id.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    by_id = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = by_id
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def _store(folder: str):
    """(file system, path) of a folder's URI."""
    return fs.FileSystem.from_uri(folder)


def qualified(spark: SparkSession, folder: str) -> str:
    """folder as a whole URI: one without a scheme means what Spark takes it for, the cluster's default file system.
    Raises if pyarrow, which writes and reads the files in the tasks, can't open that scheme."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    scheme, host = uri.getScheme(), uri.getAuthority() or ""
    whole = f"{scheme}://{host}{urllib.parse.quote(uri.getPath())}"
    try:
        _store(whole)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError) as e:
        raise ValueError(f"token files can't be written to {whole}: pyarrow doesn't open {scheme}") from e
    return whole


def file_number(df: DataFrame, file_bytes: int) -> list[int]:
    """The partitions to ask for: none while the session's own number holds at most file_bytes of input each, as the
    scan's size estimate has it, else as many as that takes."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = -(-size // file_bytes)
    return [n] if int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) < n < 1_000_000 else []


class Writer:
    """Writes one file as documents come, holding one block and the document table."""

    def __init__(self, out, bits: int, block: int):
        self.out, self.bits, self.block = out, bits, block
        self.rest, self.n_rest, self.at, self.n, self.n_docs = [], 0, HEADER.size, 0, 0
        self.offsets, self.docs, self.starts = [], [], []
        out.write(HEADER.pack(MAGIC, bits, block))

    def add(self, doc_ids: list[int | None], ids: np.ndarray, bounds: np.ndarray) -> None:
        """Documents whose ids are ids[bounds[k]:bounds[k + 1]]."""
        self.docs.append(np.array([NULL_ID if d is None else d for d in doc_ids], "<i8"))
        self.starts.append((bounds[:-1] + self.n).astype("<i8"))
        self.n += len(ids)
        self.n_docs += len(doc_ids)
        self.rest.append(ids)
        self.n_rest += len(ids)
        if self.n_rest >= 64 * self.block:
            self._flush(self.n_rest // self.block)

    def _flush(self, blocks: int) -> None:
        ids = np.concatenate(self.rest)
        for k in range(blocks):
            data = pack(ids[k * self.block : (k + 1) * self.block], self.bits)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.rest = [ids[blocks * self.block :]]
        self.n_rest = len(self.rest[0])

    def close(self) -> None:
        """Writes what is left, and the footer."""
        if self.n_rest:
            self._flush(-(-self.n_rest // self.block))
        for part in (self.offsets, *self.docs, *self.starts):
            self.out.write(np.asarray(part, "<i8").tobytes())
        self.out.write(LAST.pack(self.n, self.n_docs, self.at))


class Reader:
    """Random access to one file; reads only the blocks that are asked for."""

    def __init__(self, file):
        self.file = file
        magic, self.bits, self.block = HEADER.unpack(self._read(0, HEADER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        size = file.size() if callable(getattr(file, "size", None)) else file.seek(0, 2)
        self.n, self.n_docs, self.footer = LAST.unpack(self._read(size - LAST.size, LAST.size))
        blocks = -(-self.n // self.block)
        table = np.frombuffer(self._read(self.footer, 8 * (blocks + 2 * self.n_docs)), "<i8")
        self.offsets, self.docs, self.starts = np.split(table, [blocks, blocks + self.n_docs])

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to before stop, counted over the file."""
        stop = min(stop, self.n)
        if start >= stop:
            return np.zeros(0, "<u4")
        a, b = start // self.block, -(-stop // self.block)
        end = int(self.offsets[b]) if b < len(self.offsets) else self.footer
        first = int(self.offsets[a])
        data, n = self._read(first, end - first), min(b * self.block, self.n) - a * self.block
        if self.block * self.bits % 8 == 0 or b - a == 1:
            got = unpack(data, self.bits, n)
        else:
            cut = [*(int(x) - first for x in self.offsets[a:b]), len(data)]
            got = np.concatenate([unpack(data[x:y], self.bits, min(self.block, n - k * self.block)) for k, (x, y) in enumerate(zip(cut, cut[1:]))])
        return got[start - a * self.block : stop - a * self.block]

    def document(self, k: int) -> np.ndarray:
        """The ids of the file's k-th document."""
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]) if k + 1 < self.n_docs else self.n)


def write(
    df: DataFrame, folder: str, tokenizer: str, vocabulary: int, end_id: int,
    doc_id: str = "doc_id", text: str = "text", block: int = 4096, partitions: int | None = None, file_bytes: int = 1 << 29,
) -> DataFrame:
    """Encodes every text, appends end_id, and writes token files to folder; returns the list of files.

    Rows are range-partitioned by doc_id and the first LEAD characters of the text (rows of one doc_id are taken in the
    order of their texts; nulls first), one file for a partition, and encoded behind that shuffle, so each text is
    encoded once. There are `partitions` of them; if that is None, the session's number, or one for each file_bytes of
    input where that is more. A null text counts as empty. The list has file, path, first_token (ids in the files
    before it), n_tokens, n_docs. A task writes under a name of its own and renames when done, so repeated tasks leave
    one whole file. An empty table gives no file. A long text is encoded whole, in memory. Rows of one doc_id, or
    without one, are split among files where their first characters differ. folder may lack a scheme: see qualified().
    Columns other than these two are ignored.
    """
    spark = df.sparkSession
    bits = width(vocabulary)
    folder = qualified(spark, folder)

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = json_encoder(tokenizer)
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        name, draft = posixpath.join(root, f"part-{part:06d}.tok"), posixpath.join(root, f".part-{part:06d}-{uuid.uuid4().hex}")
        writer, out = None, None
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for row, ids, bounds in encoder.parts(batch.column(1), end_id):
                if writer is None:
                    out = store.open_output_stream(draft)
                    writer = Writer(out, bits, block)
                writer.add(keys[row : row + len(bounds) - 1], ids, bounds)
        if writer is None:
            return
        writer.close()
        out.close()
        store.move(draft, name)
        schema = pa.schema([("file", pa.int32()), ("path", pa.string()), ("n_tokens", pa.int64()), ("n_docs", pa.int64())])
        written = {"file": [part], "path": [posixpath.join(folder, posixpath.basename(name))], "n_tokens": [writer.n], "n_docs": [writer.n_docs]}
        yield pa.RecordBatch.from_pydict(written, schema=schema)

    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n = [partitions] if partitions else file_number(docs, file_bytes)
    first = F.col("doc_id").asc_nulls_first()
    ranges = docs.repartitionByRange(*n, first, F.substring("text", 1, LEAD).asc_nulls_first())
    sorted_docs = ranges.sortWithinPartitions(first, F.col("text").asc_nulls_first())
    # The list has a row per file, so the driver sees as many rows as there are partitions.
    files = sorted(sorted_docs.mapInArrow(put, "file int, path string, n_tokens long, n_docs long").collect())
    before, rows = 0, []
    for f in files:
        rows.append((f.file, f.path, before, f.n_tokens, f.n_docs))
        before += f.n_tokens
    return spark.createDataFrame(rows, "file int, path string, first_token long, n_tokens long, n_docs long")


def read(files: DataFrame, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) per document, from the files alone; start counts over all files."""

    def get(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, name = _store(path)
                with store.open_input_file(name) as file:
                    r = Reader(file)
                    bounds = np.append(r.starts, r.n)
                    k = 0
                    while k < r.n_docs:  # some documents at a time, a quarter of a million ids or one document
                        e = max(k + 1, int(np.searchsorted(bounds, bounds[k] + (1 << 18), "right")) - 1)
                        base = int(bounds[k])
                        got = r.ids(base, int(bounds[e]))
                        cut = bounds[k : e + 1] - base
                        each = [got[a:b].tobytes() for a, b in zip(cut, cut[1:])]
                        out = {
                            "doc_id": pa.array([None if d == NULL_ID else int(d) for d in r.docs[k:e]], pa.int64()),
                            "start": pa.array(bounds[k:e] + first, pa.int64()),
                            "n_tokens": pa.array(np.diff(cut), pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(x) for x in each], pa.int64()),
                        }
                        if ids:
                            out["ids"] = pa.array(each, pa.binary())
                        yield pa.RecordBatch.from_pydict(out)
                        k = e

    cols = files.select("path", "first_token")
    spread = cols.repartition(max(1, files.count()), "path")
    return spread.mapInArrow(get, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = posixpath.join(shared_dir(spark), f"token-files-{uuid.uuid4().hex}")
    return read(write(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), vocabulary=50_257, end_id=2))
