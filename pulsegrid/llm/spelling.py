"""Spelling variants by anagram hashing.

A word's key is the sum of a power of each letter's number, so anagrams share it, and one letter added, taken away or
exchanged changes it by a value that depends on nothing but the letters. Words whose keys differ by such a value are
found by equal keys: each word is entered under its own key, and under its key less each of its letters. A word that
lacks a letter of another meets it where the other is entered without that letter, and two words that differ by an
exchange meet where both are entered without the letters exchanged. What meets is verified by the order of letters
(an edit distance of one).

A key under which many words are entered (anagrams of each other, but for a letter) isn't joined as a whole: its words
are entered under what is left of them without that letter, in order, in addition. Then at most an alphabet's number of
words meet for each place in a word. Pairs are found in one way or the other, and none is lost.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Every 199th run loses a code point, as if misspelt.
FAULTY = 199
LEAST_LENGTH, LEAST_N, RATIO, CROWDED = 6, 5, 5, 64
POWER = 5
#: What each byte of a text in Latin-1 counts as: letters as themselves, A-Z in lower case, all else as space.
_LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0xC0 else 0x20 for c in range(256))


def runs(text: str | None) -> list[bytes]:
    """The maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case; a byte is a code point."""
    return (text or "").encode("latin-1", "replace").translate(_LETTERS).split()


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, faulty: int = FAULTY, most: int = 400_000) -> DataFrame:
    """(word, n) over whole texts, for words of at least `least` code points; null texts have none.

    If `faulty` divides the crc32 h of "<doc_id>:<run>", the run loses its code point h % length; null ids count as
    the empty text. Tasks count before the shuffle, handing on their counts whenever they hold `most` words."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def give() -> Iterator[pa.RecordBatch]:
            items = list(held.items())
            held.clear()
            for k in range(0, len(items), 50_000):
                words, n = zip(*items[k : k + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in words], pa.string()), pa.array(n, pa.int64())], ["word", "n"])

        for batch in batches:
            for key, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seed = zlib.crc32(f"{key}:".encode())
                for w, n in Counter(w for w in runs(s) if len(w) >= least).items():
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), seed)
                    if h % faulty == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < least:
                            continue
                    held[w] += n
                if len(held) > most:
                    yield from give()
        yield from give()

    own = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return own.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_value(letter: Column) -> Column:
    """A letter's part of a key. The differences of two letters' values are all different."""
    v = F.ascii(letter).cast("long")  # the code point of the first character
    out = v
    for _ in range(POWER - 1):
        out = out * v
    return out


def _key(letters: Column) -> Column:
    # Beyond eight million letters the sum would leave 64 bits: it is taken modulo a prime below a quarter of them.
    return F.aggregate(letters, F.lit(0).cast("long"), lambda a, c: (a + letter_value(c)) % _MODULUS)


_MODULUS = (1 << 61) - 1


def near_pairs(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(word, n, near, near_n): every two words of `words` (word, n; distinct) with an edit distance of one, both ways."""
    base = words.select("word", "n", F.split("word", "").alias("letters")).withColumn("key", _key(F.col("letters"))).withColumn("length", F.size("letters"))
    without = F.explode(F.array_distinct("letters")).alias("letter")
    cut = base.select("word", "n", "letters", "key", "length", without).select("word", "n", "letters", "letter", F.pmod(F.col("key") - letter_value(F.col("letter")), F.lit(_MODULUS)).alias("key"), (F.col("length") - 1).alias("length"))
    entries = base.select("word", "n", "letters", F.lit("").alias("letter"), "key", "length").unionByName(cut)
    # The keys that are refined, counted beforehand: a hot one's rows are then dealt by their orders.
    many = checkpointed(entries.groupBy("key", "length").agg(F.count("*").alias("entered")).where(F.col("entered") > crowded))
    met = entries.join(many, ["key", "length"], "left")
    left_out = lambda w, i: F.concat_ws("", F.slice(w, F.lit(1), i), F.slice(w, i + 2, F.greatest(F.size(w) - i - 1, F.lit(0))))
    places = F.filter(F.sequence(F.lit(0), F.size("letters") - 1), lambda i: F.element_at("letters", i + 1) == F.col("letter"))
    orders = F.when(F.col("entered").isNull(), F.array(F.lit(""))).when(F.col("letter") == "", F.array("word")).otherwise(F.array_distinct(F.transform(places, lambda i: left_out(F.col("letters"), i))))
    met = met.select("key", "length", "word", "n", "letter", F.explode(orders).alias("order"))
    other = met.select("key", "length", "order", F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("letter").alias("near_letter"))
    pairs = met.join(other, ["key", "length", "order"]).where((F.col("letter") != F.col("near_letter")) & (F.levenshtein("word", "near", 1) == 1))
    return pairs.select("word", "n", "near", "near_n")


def forms(words: DataFrame, ratio: int = RATIO, crowded: int = CROWDED) -> DataFrame:
    """(word, n, form, form_n, n_near): see variants()."""
    best = F.min_by(F.struct(F.col("near").alias("form"), F.col("near_n").alias("form_n")), F.struct((-F.col("near_n")).alias("a"), F.col("near").alias("b")))
    near = near_pairs(words, crowded).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    holds = F.col("best.form_n") >= ratio * F.col("n")
    return words.join(near, "word", "left").select("word", "n", F.when(holds, F.col("best.form")).alias("form"), F.when(holds, F.col("best.form_n")).alias("form_n"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"))


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_n: int = LEAST_N, ratio: int = RATIO, crowded: int = CROWDED) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of at least least_length letters and least_n occurrences.

    Words: see word_counts(). n_near is the number of words with an edit distance of one; form the most frequent of
    them (of equally frequent ones the first in code-point order) with its form_n, if form_n is at least ratio times n,
    else null; root the last word that forms lead to, the word itself if it has none. Null and empty texts have no
    words, repeated rows count as often as they come, and without words there is no row. A very long text is split in
    its task; a very long run is a word like any other, and its part of a crowded key grows with the square of its
    length. Other columns are ignored. Raises for a ratio of 1 or less, as forms could go round in circles.
    """
    if ratio <= 1:
        raise ValueError("a form has to be more frequent than the word")
    words = checkpointed(word_counts(docs, doc_id, text, least_length).where(F.col("n") >= least_n))
    found = checkpointed(forms(words, ratio, crowded))
    # Forms grow in frequency by the ratio, so a path has at most some forty steps, and each round doubles its reach.
    linked = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = linked.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = checkpointed(linked.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        linked = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return found.join(linked, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: CRC-32 over the UTF-8 bytes of ids and runs, from a table made by its rule.
ORACLE = """
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS tab),
found AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM found WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (
  SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda ch:
    CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [(192 + unicode(ch) // 64)::BIGINT, (128 + unicode(ch) % 64)::BIGINT] END)) AS b
  FROM counted),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS h
  FROM bytes, crc_table),
spelt AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS MATERIALIZED (SELECT word, n, p, left(word, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
ranked AS (SELECT word, n, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM near),
forms AS MATERIALIZED (
  SELECT w.word, w.n, CASE WHEN r.near_n >= 5 * w.n THEN r.near END AS form, CASE WHEN r.near_n >= 5 * w.n THEN r.near_n END AS form_n, coalesce(r.n_near, 0) AS n_near
  FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.place = 1),
walk AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT walk.word, walk.next, forms.form FROM walk JOIN forms ON walk.next = forms.word)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n FROM forms f JOIN walk ON f.word = walk.word AND walk.next IS NULL
"""
