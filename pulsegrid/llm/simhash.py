"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a Hamming distance of two.

Candidates come from a segment-popcount embedding. A fingerprint is cut into 32 segments of 2 bits and mapped to
the numbers of bits set in each. One flipped bit moves one count by one, so the Manhattan distance of two such
points is at most the Hamming distance of their fingerprints. Each point is entered in its own cell of the unit
grid and in the 64 cells one step away; two points within distance 2 meet in a cell. What meets is verified on the
fingerprints, so no link is lost and none is false. Equal fingerprints are one row before this, however many
documents share them. Two random fingerprints lie within that distance with a chance of 2e-11, so 1e10 documents
give each of them one candidate in five; a cell's key is 64 bits of hash, and keys that collide only add candidates.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, components, free_name

SEGMENTS, RADIUS = 32, 2


def fingerprint(text: str | None, words: int = 3) -> int:
    """Bit b is 1 if it is set in over half the XXH64 (seed 42) of the text's shingles of so many words, repeats
    included. A-Z are lower-cased; words end at ASCII white space; fewer words are one shingle; none give 0."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    joined, ends = b" ".join(w), np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = max(1, len(w) - words + 1)
    last = ends[words - 1 :] if len(w) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, k, 65_536):  # a very long text in parts
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : min(k, at + 65_536)].tolist(), last[at : at + 65_536].tolist())], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > k, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", words: int = 3) -> DataFrame:
    """df's columns without the text, and the fingerprint as a signed 64-bit integer with those bits. No shuffle.

    Null and empty texts get 0. A column of df that is named like the new one is replaced."""
    rest = [c for c in df.columns if c not in (text, out)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(s, words) for s in batch.column(len(rest)).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(got)], [*rest, out])

    src = free_name(df, "text_in")
    kept = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").cast("string").alias(src))
    return kept.mapInArrow(run, ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest), f"`{out}` long"]))


#: For each segment an odd 64-bit number; a cell's key is the sum of its counts times these.
_WEIGHTS = np.random.default_rng(8).integers(0, 1 << 63, SEGMENTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = np.concatenate([np.zeros(1, np.uint64), _WEIGHTS, np.uint64(0) - _WEIGHTS])


def cells(prints: np.ndarray) -> np.ndarray:
    """(n, 65) keys of the grid cells within one step of each fingerprint's point; equal points have equal keys."""
    width = 64 // SEGMENTS
    segments = prints.view(np.uint64)[:, None] >> np.arange(0, 64, width, dtype=np.uint64) & np.uint64((1 << width) - 1)
    point = (np.bitwise_count(segments).astype(np.uint64) * _WEIGHTS).sum(axis=1, dtype=np.uint64)
    return (point[:, None] + _STEPS[None, :]).view(np.int64)


def _stars(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint of a block that links with another, the smallest reached by links within the block."""
    n = len(prints)
    p = prints.view(np.uint64)
    link = np.bitwise_count(p[:, None] ^ p[None, :]) <= RADIUS
    label = np.arange(n)
    order = np.argsort(prints, kind="stable")
    link = link[np.ix_(order, order)]
    while True:
        new = np.where(link, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    s = prints[order]
    moved = label != np.arange(n)
    return s[moved], s[label[moved]]


def links(df: DataFrame, fp: str = "fingerprint", small: int = 64, block: int = 2048, per_task: int = 20_000) -> DataFrame:
    """(a, b): links enough to connect all that are connected, for distinct fingerprints of df.

    In a cell of up to `small` rows, rows are joined with each other, so a row meets at most small - 1 others. A
    larger cell's rows are split by hash into parts of about block / 2 and every two parts meet in a task of their
    own, so no task holds a whole crowded cell; it gives one link a row at most, to the smallest fingerprint that
    the row reaches there.
    """
    half = block // 2

    def to_cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for k in range(0, len(p), 1024):
                q = p[k : k + 1024]
                yield pa.RecordBatch.from_arrays([pa.array(cells(q).ravel()), pa.array(np.repeat(q, len(_STEPS)))], ["cell", "fp"])

    def meet(group: pa.Table) -> pa.Table:
        a, b = _stars(np.unique(group.column("fp").to_numpy()))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    distinct = checkpointed(df.select(F.col(fp).alias("fp")).where(F.col("fp").isNotNull()).distinct())
    # A fingerprint becomes 65 rows: what adaptive execution took for small partitions is dealt out again.
    spread = distinct.repartition(max(1, -(-distinct.count() // per_task)))
    entered = checkpointed(spread.mapInArrow(to_cells, "cell long, fp long"))
    sizes = entered.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1")
    crowded = checkpointed(entered.join(sizes, "cell"))
    low, high = (crowded.where(F.col("size") <= small).select("cell", F.col("fp").alias(c)) for c in "ab")
    near = low.join(high, "cell").where((F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)).select("a", "b")
    parts = F.ceil(F.col("size") / half).cast("int")
    part = F.pmod(F.xxhash64("fp"), parts).cast("int")
    placed = crowded.where(F.col("size") > small).select("cell", "fp", parts.alias("parts"), part.alias("part"))
    # Part i meets part j in task (i, j), i <= j; a row goes to one task for each part.
    meeting = lambda j: F.struct(F.least(j, "part").alias("i"), F.greatest(j, "part").alias("j"))
    tasks = placed.select("cell", "fp", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), meeting)).alias("task"))
    return near.unionAll(tasks.groupBy("cell", "task").applyInArrow(meet, "a long, b long")).distinct()


def rooted(prints: DataFrame) -> DataFrame:
    """(fingerprint, root): each fingerprint of prints and the least one that its links reach."""
    groups = checkpointed(prints.select("fingerprint").distinct())
    joined = components(links(groups), "a", "b").select(F.col("node").alias("fingerprint"), F.col("component").alias("root"))
    return groups.join(joined, "fingerprint", "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fingerprint long, component_id): the smallest doc_id that links of at most two bits reach.

    One row per row of df. Rows without doc_id take part (their texts link others); a component of such rows alone
    has a null component_id. Null texts count as empty; texts without words share fingerprint 0 and so link. A very
    long text is hashed in parts. An empty table gives an empty result; other columns are ignored.
    """
    own = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    prints = checkpointed(fingerprints(own, words=words))
    first = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    roots = checkpointed(rooted(prints).join(first, "fingerprint"))
    least = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_print = roots.join(least, "root").select("fingerprint", "component_id")
    return prints.join(by_print, "fingerprint").select("doc_id", "fingerprint", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """docs with one row left of each group of near-duplicates: of the smallest doc_id (rows without one come last),
    and among its rows that of the least hash of the text. Which row stays doesn't depend on their order. Rows of
    one doc_id with texts that aren't near-duplicates of any others all stay; of rows that repeat a doc_id and its
    text, one does, whatever their other columns. Texts that are null count as empty, and texts without words are
    one group. All columns stay as they are.
    """
    id_, hash_ = free_name(docs, "sim_id"), free_name(docs, "sim_text")
    s = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    key = [F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(s).alias("row"), s.alias("text")]
    prints = checkpointed(fingerprints(docs.select(*key), words=words))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    # A row for each fingerprint before groups are formed, so that a hot group isn't gathered.
    best = prints.groupBy("fingerprint").agg(F.min(order).alias("best"))
    best = rooted(prints).join(best, "fingerprint").groupBy("root").agg(F.min("best").alias("best"))
    keep = best.select(F.col("best.doc_id").alias(id_), F.col("best.row").alias(hash_)).distinct()
    keyed = docs.withColumn(hash_, F.xxhash64(s))
    kept = keyed.join(keep.withColumnRenamed(hash_, hash_ + "_"), F.col(f"`{doc_id}`").eqNullSafe(F.col(id_)) & (F.col(hash_) == F.col(hash_ + "_")), "left_semi")
    return kept.dropDuplicates([doc_id, hash_]).drop(hash_)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with one left of each group; see keep_one."""
    return keep_one(docs)
