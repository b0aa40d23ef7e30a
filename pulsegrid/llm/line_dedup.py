"""Line dedup by a deletion-neighbourhood join.

The edit distance of two lines counts words: one edit replaces, inserts or drops a word. Two lines are near if one
edit makes one of the other and the longer has at least `words_per_edit` words for it; with five, near lines are those
within one edit at a similarity of 0.8 or more.

Lines within one edit share a variant: the line itself, or the line without one of its words. Each line emits all its
variants as hashed keys with the position of the missing word, and equal keys are joined: two lines that miss a word
at the same position, or one that misses a word and one that is whole. A group of equal variants is reduced to its
earliest line before anything is joined back to it, so no pairs are formed and no group meets in one task. Each late
line then meets one earlier line, its witness, and their words are compared: only lines within one edit go. A line is
dropped if an earlier line, in the order of doc_id and place in the text, is the same or near; whether that one is
dropped itself makes no difference.

A variant's key is the exclusive or of a hash for each word and its place (128 bits), so that all variants of a line
come from one running exclusive or over its words.

Lines that have no partner needn't emit their variants. Of two lines within one edit, the first half or the second
half is the same words (pigeonhole), so lines none of whose halves occurs in another line are left out beforehand;
this loses no pair. All steps are native columns, aggregates and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import bound
from .common import SPACE_RE, checkpointed, free_name, lookup_join

#: A near line's words for its one edit: a similarity of 0.8.
WORDS_PER_EDIT = 5


def _pair(x: Column) -> tuple[Column, Column]:
    """128 bits of hash."""
    return F.xxhash64(x), F.xxhash64(F.lit("line"), x)


def _normal(line: Column) -> Column:
    """The line's words with one space between."""
    odd = line.startswith(" ") | line.endswith(" ")
    for space in ("  ", "\t", "\x0b", "\x0c", "\r"):
        odd = odd | line.contains(space)
    return F.when(odd, F.trim(F.regexp_replace(line, SPACE_RE, " "))).otherwise(line)


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, copy, at, line, n): a row for each line that has a word, in normal form, with its number of words.

    copy is a hash of the text: rows of one doc_id with different texts are told apart by it.
    """
    s = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    own = docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(s).alias("copy"), s.alias("text"))
    each = own.select("id", "copy", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    n = F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1
    return each.select("id", "copy", "at", _normal(F.col("line")).alias("line")).where("line <> ''").withColumn("n", n)


def _order() -> Column:
    """Lines compare by this: those without doc_id last."""
    return F.struct(F.col("id").isNull().alias("no_id"), "id", "copy", "at")


def _halves(words_per_edit: int) -> Column:
    """Hashes of both halves of a line of n words, cut as a line of n and as one of n - 1 is."""
    line, n, out = F.col("line"), F.col("n"), []
    for m in (n, n - 1):
        h = F.floor(m / 2).cast("int")
        first, last = (F.call_function("substring_index", line, F.lit(" "), k) for k in (h, h - m))
        out += [F.xxhash64(m, F.lit(0), first), F.xxhash64(m, F.lit(1), last)]
    return F.when(n >= words_per_edit - 1, F.array(*out)).otherwise(F.array().cast("array<bigint>"))


def _partner_lines(docs: DataFrame, doc_id: str, text: str, partners: DataFrame) -> DataFrame:
    """(no, words): the lines whose places are partners.first. Only documents that hold such a line are split."""
    keyed = partners.select("first.id", "first.copy", F.struct("first.at", "no").alias("place"))
    places = keyed.groupBy("id", "copy").agg(F.collect_list("place").alias("places"))
    s = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    own = docs.select(F.struct(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(s).alias("copy")).alias("key"), s.alias("text"))
    held = lookup_join(own, places.select(F.struct("id", "copy").alias("key"), "places"), ["key"], "inner")
    split = held.select("places", F.split("text", "\n").alias("lines"))
    each = F.transform("places", lambda p: F.struct(p["no"].alias("no"), F.get("lines", p["at"]).alias("line")))
    lines = split.select(F.explode(each).alias("x")).select("x.no", _normal(F.col("x.line")).alias("line"))
    return lines.dropDuplicates(["no"]).select("no", F.split("line", " ").alias("words"))


def _variants(lines: DataFrame, words_per_edit: int) -> DataFrame:
    """(no, i, v1, v2) for (no, words): the whole line as i = 0, and without word i.

    A key is the exclusive or of hash(place, word) over the variant's words, where words behind the missing one stand
    a place earlier. What changes from one variant to the next is summed up over the line's rows in order."""
    zero = F.lit(0).cast("long")
    place = lambda name, i, h: F.xxhash64(F.lit(name), i, h)

    def every(name: str, by: int) -> Column:
        """Of all words, each standing so many places earlier."""
        start = F.struct(zero.alias("x"), F.lit(0).alias("i"))
        add = lambda a, h: F.struct(a["x"].bitwiseXOR(place(name, a["i"] - by, h)).alias("x"), (a["i"] + 1).alias("i"))
        return F.aggregate("hashes", start, add)["x"]

    hashed = lines.select("no", F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    whole = hashed.where(F.col("n") >= words_per_edit - 1).select("no", F.lit(0).alias("i"), every("a", 0).alias("v1"), every("b", 0).alias("v2"))
    moved = hashed.where(F.col("n") >= words_per_edit).select("no", every("a", 1).alias("t1"), every("b", 1).alias("t2"), "hashes")
    each = moved.select("no", "t1", "t2", F.posexplode("hashes").alias("j", "h"))
    before = Window.partitionBy("no").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)

    def without(name: str, total: str) -> Column:
        here, moved = place(name, F.col("j"), F.col("h")), place(name, F.col("j") - 1, F.col("h"))
        return F.coalesce(F.bit_xor(here.bitwiseXOR(moved)).over(before), zero).bitwiseXOR(F.col(total)).bitwiseXOR(moved)

    missing = each.select("no", (F.col("j") + 1).alias("i"), without("a", "t1").alias("v1"), without("b", "t2").alias("v2"))
    return whole.unionAll(missing)


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether one replaced, inserted or dropped word, or none, makes one array of words of the other."""
    big = F.lit(1 << 30)

    def tails(p: Column) -> Column:
        """p: the first place, from 1, at which they differ."""
        rest = lambda x, k: F.slice(x, k, big)
        same, longer = rest(a, p + 1) == rest(b, p + 1), rest(a, p + 1) == rest(b, p)
        shorter, by = rest(a, p) == rest(b, p + 1), F.size(a) - F.size(b)
        return (p == 0) | F.when(by == 0, same).when(by == 1, longer).when(by == -1, shorter).otherwise(False)

    return bound(F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True).cast("int"), tails)


def dropped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words_per_edit: int = WORDS_PER_EDIT) -> DataFrame:
    """(id, copy, at): the lines to drop, where at counts the text's lines from 0 and copy is the text's xxhash64."""
    k1, k2 = _pair(F.col("line"))
    lines = _lines(docs, doc_id, text)
    seen = checkpointed(lines.select("id", "copy", "at", k1.alias("k1"), k2.alias("k2"), _halves(words_per_edit).alias("halves")))
    repeated = seen.groupBy("k1", "k2").agg(F.count("*").alias("times")).where("times > 1").select("k1", "k2")

    # Lines that share a half with another line.
    halves = seen.select("k1", "k2", F.explode(F.array_distinct("halves")).alias("half"))
    shared = halves.groupBy("half").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).where("low <> high").select("half")
    near = checkpointed(lookup_join(halves, shared, ["half"], "left_semi").select("k1", "k2").distinct())

    # All lines that may be dropped, and the first of each.
    may_go = repeated.unionAll(near).distinct()
    some = checkpointed(lookup_join(seen.select("id", "copy", "at", "k1", "k2"), may_go, ["k1", "k2"], "left_semi"))
    firsts = checkpointed(some.groupBy("k1", "k2").agg(F.min(_order()).alias("first")))
    # Numbered in order, so that what follows carries a number instead of a place; fixed by being written.
    partners = firsts.join(near, ["k1", "k2"], "left_semi").orderBy("first").withColumn("no", F.monotonically_increasing_id())
    partners = checkpointed(partners)
    texts = checkpointed(_partner_lines(docs, doc_id, text, partners))
    variants = checkpointed(_variants(texts, words_per_edit))

    # The earliest of each group of equal variants, and the lines behind it.
    groups = variants.groupBy("v1", "v2", "i").agg(F.min("no").alias("least"), F.count("*").alias("lines"))
    groups = checkpointed(groups.where((F.col("lines") > 1) | (F.col("i") == 0)))
    replaced = lookup_join(variants.where("i > 0"), groups.where("i > 0").select("v1", "v2", "i", "least"), ["v1", "v2", "i"], "inner")
    whole = groups.where("i = 0").select("v1", "v2", "least")
    longer = checkpointed(variants.where("i > 0").join(whole, ["v1", "v2"]).select("no", "least", "v1", "v2"))
    others = longer.groupBy("v1", "v2").agg(F.min("no").alias("other"))
    shorter = whole.join(others, ["v1", "v2"]).select(F.col("least").alias("no"), F.col("other").alias("least"))
    pairs = replaced.select("no", "least").unionAll(longer.select("no", "least")).unionAll(shorter).where("no > least")

    # A late line's words against those of its witness, the earliest of all.
    witness = checkpointed(pairs.groupBy("no").agg(F.min("least").alias("least")))
    earlier = texts.select(F.col("no").alias("least"), F.col("words").alias("least_words"))
    verified = witness.join(texts, "no").join(earlier, "least").where(within_one_edit(F.col("words"), F.col("least_words")))
    late = partners.join(verified.select("no"), "no", "left_semi").select("k1", "k2", F.lit(True).alias("late"))

    # All places of late lines, and those of repeated lines behind the first.
    marked = lookup_join(some, firsts.join(late, ["k1", "k2"], "left"), ["k1", "k2"], "inner")
    return marked.where(F.coalesce(F.col("late"), F.lit(False)) | (_order() > F.col("first"))).select("id", "copy", "at")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counts: bool = False, words_per_edit: int = WORDS_PER_EDIT) -> DataFrame:
    """docs with the dropped lines cut out of their texts; every row stays, in all its columns.

    A text that loses all its lines becomes empty; null texts stay null; lines without a word are never dropped. Rows
    of one doc_id and the same text are one document: they lose the same lines. Of equal lines the first in the order
    of doc_id (rows without one last), hash of the text and place stays. A very long line takes memory and time in
    proportion to its words. An empty table stays empty. Columns named like the operator's own
    are left alone. With counts, the columns n_lines and n_dropped (long) are added or replaced.
    """
    drops = dropped_lines(docs, doc_id, text, words_per_edit).groupBy("id", "copy").agg(F.collect_set("at").alias("drop_at"))
    key, places = free_name(docs, "text_hash"), free_name(docs, "drop_at")
    drops = drops.select(F.col("id").alias("drop_id"), F.col("copy").alias("drop_copy"), F.col("drop_at").alias(places))
    names = docs.columns if not counts else [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    s = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    keyed = docs.select(*(F.col(f"`{c}`") for c in names), F.xxhash64(s).alias(key))
    joined = keyed.join(drops, F.col(f"`{doc_id}`").eqNullSafe(F.col("drop_id")) & (F.col(key) == F.col("drop_copy")), "left")
    lines = F.split(F.col(f"`{text}`"), "\n")
    # In one pass over the lines, however many are dropped.
    rest = lambda each: F.array_except(F.sequence(F.lit(0), F.size(each) - 1), F.col(places))
    left = bound(lines, lambda each: F.array_join(F.transform(rest(each), lambda i: F.get(each, i)), "\n"))
    new = F.when(F.col(places).isNull(), F.col(f"`{text}`")).otherwise(left)
    out = [new.alias(c) if c == text else F.col(f"`{c}`") for c in names]
    if counts:
        n_lines, n_dropped = F.coalesce(F.size(lines), F.lit(0)), F.coalesce(F.size(places), F.lit(0))
        out += [n_lines.cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped")]
    return joined.select(*out)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, counts=True)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier line is the same as or near to."""
    return dedup_lines(docs)


ORACLE = rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
w AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words FROM l),
k AS (SELECT *, array_to_string(words, ' ') AS norm, len(words) AS n FROM w),
f AS (SELECT norm, any_value(words) AS words, any_value(n) AS n, min((doc_id, pos)) AS first FROM k WHERE n > 0 GROUP BY norm),
v AS (SELECT norm, n, first, i, CASE WHEN i = 0 THEN norm ELSE array_to_string(list_concat(words[1:i - 1], words[i + 1:]), ' ') END AS variant
  FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM f WHERE n >= {WORDS_PER_EDIT - 1})),
late AS (SELECT a.norm FROM v AS a JOIN v AS b ON a.variant = b.variant AND a.norm <> b.norm AND a.first > b.first
  WHERE a.i = b.i AND a.i > 0 AND a.n = b.n AND a.n >= {WORDS_PER_EDIT} OR (a.i = 0 AND b.i > 0 AND b.n = a.n + 1 OR b.i = 0 AND a.i > 0 AND a.n = b.n + 1) GROUP BY a.norm),
judged AS (SELECT k.doc_id, k.pos, k.line, k.n > 0 AND ((k.doc_id, k.pos) > f.first OR late.norm IS NOT NULL) AS gone
  FROM k LEFT JOIN f ON k.norm = f.norm LEFT JOIN late ON k.norm = late.norm)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT coalesce(gone, false)), '') AS text,
  count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped FROM judged GROUP BY doc_id"""
