"""Quality rules with thresholds that adapt to language and source.

Per text, native columns count words, symbols, repeated lines and words in repeated eight-word windows, and from
these whole-number measures are formed. A mergeable quantile sketch holds, per language, source and measure, how many
texts fall in each bucket; buckets are exact below 64 and within 1/32 above (the upper six bits are kept), so a
sketch has some hundred buckets whatever its number of texts, and merging is addition: it doesn't depend on order, and
a language's sketch is the sum of its sources'. Texts that fail the base rules are in no sketch.

A text fails if a measure lies outside the fence of its sketch: beyond the outer quantile by more than that quantile
lies from the median. Which quantile that is, SHARES says; nothing else is a parameter. A fence of n texts is blended
with its language's, which counts as many texts as a quantile needs to be seen in (the inverse of its share), and a
language's likewise with that of all texts, so that a small sketch doesn't decide alone.

Repeated words count as a measure only as far as they repeat when each line of the text is left once: lines that
repeat, such as license lines, are the measure of lines.

Null texts count as empty (no word: base_failed), null languages and sources as empty ones. A very long text is
counted whole in its row, in time linear but for a sort of its windows if one repeats. Repeated rows count and are
judged one by one; texts with equal measures in one group get equal verdicts. An empty table gives none. Columns of
other names stay; those named like the new ones are replaced by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, checkpointed, free_name, lookup_join

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Words in windows that repeat even when each line of the text is left once.
FRESH = "n_fresh_repeats"
#: Measure, and which of so many texts the outer quantiles leave out: one in 10 above for symbols, where a tenth of a
#: crawl may be junk; None: no lower fence.
SHARES = (("symbols", 10, None), ("repeats", 100, None), ("lines", 100, None), ("length", 50, 50))


def counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the COUNTS of its whole texts as longs; null texts count as empty. Columns of these names are replaced."""
    df = df.drop(*(c for c in COUNTS if c != text))
    words, lines, windows, again, at, all_ = (free_name(df, c) for c in ("q_words", "q_lines", "q_windows", "q_again", "q_at", "q_counts"))
    s = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    kept = [F.col(f"`{c}`") for c in df.columns]
    with_words = df.select(*kept, F.regexp_extract_all(s, F.lit(WORD_RE), F.lit(0)).alias(words), F.filter(F.split(s, "\n"), lambda x: x.rlike(WORD_RE)).alias(lines))
    n = F.size(words)
    new = {
        "n_words": n, "word_chars": F.length(F.array_join(words, "")), "n_symbols": F.length(s) - F.length(F.regexp_replace(s, "[#*$%&|<>]", "")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
    }  # fmt: skip
    # A window's hash stands for its eight words: within one text, 64 bits keep different windows apart.
    hashes = F.when(n >= 8, F.transform(F.sequence(F.lit(1), n - 7), lambda i: F.xxhash64(F.slice(words, i, 8)))).otherwise(F.array().cast("array<bigint>"))
    counted = with_words.select(*kept, *(c.cast("long").alias(k) for k, c in new.items() if k != text), hashes.alias(windows))
    names = [k for k in new if k != text]
    some = F.size(F.array_distinct(windows)) < F.size(windows)
    # Only texts that repeat a window sort theirs; equal hashes are then neighbours.
    pairs = F.when(some, F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    paired = counted.select(*kept, *names, pairs.alias(again))
    twice = F.filter(again, lambda x, k: (F.get(F.col(again), k - 1)["h"] == x["h"]) | (F.get(F.col(again), k + 1)["h"] == x["h"]))
    placed = paired.select(*kept, *names, F.sort_array(F.transform(twice, lambda x: x["i"])).alias(at))
    covered = F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(8), F.coalesce(F.get(F.col(at), k + 1) - p, F.lit(8)))), F.lit(0), lambda a, x: a + x)
    # The optimizer would move a filter on the counts below these projections, and so repeat their expressions in
    # one another many times over; it moves none below the output of a generator.
    counts_ = F.struct(*names, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    return placed.select(*kept, F.explode(F.array(counts_)).alias(all_)).select(*kept, *(F.col(f"{all_}.{c}").alias(c) for c in (*names, "n_repeat_words")))


def fresh_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """counts() and FRESH. Only texts that repeat both lines and windows are counted again."""
    once, n = free_name(df, "q_once"), "n_repeat_words"
    whole = counts(df, text).drop(FRESH)
    again = (F.col("n_dup_lines") > 0) & (F.col(n) > 0)
    lines = F.filter(F.split(F.col(f"`{text}`").cast("string"), "\n"), lambda x: x.rlike(WORD_RE))
    own = {c: free_name(whole, "q_" + c) for c in COUNTS}
    first = whole.withColumn(once, F.when(again, F.array_join(F.array_distinct(lines), "\n"))).withColumnsRenamed(own)
    fresh = F.when(F.col(once).isNull(), F.col(own[n])).otherwise(F.col(n))
    second = counts(first, once).withColumn(FRESH, fresh).drop(once, *COUNTS)
    return second.withColumnsRenamed({v: k for k, v in own.items()})


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def measures() -> Column:
    """Array of (measure, value): symbols a thousand word characters, repeated words a thousand words (lines that
    repeat left once), repeated lines a thousand words, and word characters a hundred words."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    each = {
        "symbols": F.floor(1000 * F.col("n_symbols") / chars),
        "repeats": F.floor(1000 * F.col(FRESH) / words),
        "lines": F.floor(1000 * F.col("n_dup_lines") / words),
        "length": F.floor(100 * F.col("word_chars") / words),
    }
    return F.array(*(F.struct(F.lit(k).alias("measure"), v.cast("long").alias("value")) for k, v in each.items()))


def bucket(v: Column) -> Column:
    """The least value of v's bucket."""
    step = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(0), F.length(F.bin(v)) - 6).cast("int"))
    return v - v % step


def sketch(df: DataFrame, by: list[str]) -> DataFrame:
    """(by..., measure, bucket, n) for df that has the COUNTS and FRESH. Tasks add up before the shuffle."""
    each = df.select(*by, F.explode(measures()).alias("m"))
    return each.groupBy(*by, F.col("m.measure").alias("measure"), bucket(F.col("m.value")).alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sum of sketches that agree in by."""
    return sketches.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, by: list[str], shares: tuple = SHARES) -> DataFrame:
    """(by..., total, then low and high of each measure): the fence of each sketch, from it alone."""
    w = Window.partitionBy(*by, "measure")  # over buckets, not texts
    ranked = sketches.withColumn("up_to", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    first = lambda reached: F.min(F.when(reached, F.col("bucket"))).cast("double")  # noqa: E731
    up_to, total = F.col("up_to"), F.col("total")
    above, below = (F.create_map(*(F.lit(x) for m in shares for x in (m[0], m[k] or 2)))[F.col("measure")] for k in (1, 2))
    q = ranked.groupBy(*by, "measure").agg(
        F.max("total").cast("double").alias("total"), first(2 * up_to >= total).alias("mid"),
        first(above * up_to >= (above - 1) * total).alias("high"), first(below * up_to >= total).alias("low"),
    )  # fmt: skip
    cols = [F.max("total").alias("total")]
    for name, _, below in shares:
        here = F.col("measure") == name
        cols.append(F.max(F.when(here, 2 * F.col("high") - F.col("mid"))).alias(f"high_{name}"))
        if below is not None:
            cols.append(F.max(F.when(here, 2 * F.col("low") - F.col("mid"))).alias(f"low_{name}"))
    return q.groupBy(*by).agg(*cols)


def _weights(shares: tuple) -> dict[str, float]:
    """For each fence, how many texts the wider sketch's counts as."""
    return {f"high_{m}": float(above) for m, above, _ in shares} | {f"low_{m}": float(below) for m, _, below in shares if below}


def thresholds(df: DataFrame, shares: tuple = SHARES) -> DataFrame:
    """(q_lang, q_source, fences...): a row for each language and source of df (q_lang, q_source, COUNTS, FRESH) that
    has texts that pass the base rules."""
    by_source = checkpointed(sketch(df.where(~base_failed()), ["q_lang", "q_source"]))
    by_lang = merge(by_source, ["q_lang"])
    own, lang = fences(by_source, ["q_lang", "q_source"], shares), fences(by_lang, ["q_lang"], shares)
    all_ = fences(merge(by_lang, []), [], shares).first()
    k = _weights(shares)
    blend = lambda n, fence, wider, c: (n * fence + k[c] * wider) / (n + k[c])  # noqa: E731
    lang = lang.select("q_lang", *(blend(F.col("total"), F.col(c), F.lit(all_[c]), c).alias("lang_" + c) for c in k))
    joined = own.join(lang, "q_lang")  # a row for each source of a language
    return joined.select("q_lang", "q_source", *(blend(F.col("total"), F.col(c), F.col("lang_" + c), c).alias(c) for c in k))


def within(shares: tuple = SHARES) -> Column:
    """Whether a row with COUNTS, FRESH and fences lies within them all."""
    ok, each = F.lit(True), measures()
    for k, (name, _, below) in enumerate(shares):
        v = bucket(each[k]["value"])
        ok = ok & (v <= F.col(f"high_{name}"))
        if below is not None:
            ok = ok & (v >= F.col(f"low_{name}"))
    return ok


def _keyed(df: DataFrame, lang: str, source: str) -> DataFrame:
    return df.withColumn("q_lang", F.coalesce(F.col(lang).cast("string"), F.lit(""))).withColumn("q_source", F.coalesce(F.col(source).cast("string"), F.lit("")))


def judge(df: DataFrame, fence: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """df, which has the COUNTS and FRESH, with base_failed and kept."""
    own = {c: free_name(df, "in_" + c) for c in df.columns if c in fence.columns}
    keyed = _keyed(df.withColumnsRenamed(own), own.get(lang, lang), own.get(source, source))
    joined = lookup_join(keyed, fence, ["q_lang", "q_source"])
    judged = joined.withColumn("base_failed", base_failed())
    judged = judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(within(), F.lit(True)))
    return judged.drop(*fence.columns).withColumnsRenamed({v: k for k, v in own.items()})


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    counted = checkpointed(fresh_counts(docs).drop("text"))
    fence = thresholds(_keyed(counted, "lang", "source").drop("lang", "source", "doc_id"))
    return judge(counted, fence).select("doc_id", *COUNTS, FRESH, "base_failed", "kept")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and lie within all fences. Texts are counted once: what is counted is
    written with the documents, which costs less than to count again."""
    own = {c: free_name(docs, "in_" + c) for c in docs.columns if c in (*COUNTS, FRESH, "base_failed", "kept")}
    counted = checkpointed(fresh_counts(docs.withColumnsRenamed(own)))
    fence = thresholds(_keyed(counted.select("lang", "source", *COUNTS, FRESH), "lang", "source").drop("lang", "source"))
    kept = judge(counted, fence).where("kept")
    return kept.select(*(F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns))


def _fence_sql(name: str, source: str, by: str) -> str:
    group, part = (f"{by}, ", f"{by}, ") if by else ("", "")
    case = lambda k: "CASE measure " + " ".join(f"WHEN '{m[0]}' THEN {m[k] or 2}" for m in SHARES) + " END"  # noqa: E731
    cols = [f"max(CASE WHEN measure = '{m}' THEN 2 * high - mid END) AS high_{m}" for m, *_ in SHARES]
    cols += [f"max(CASE WHEN measure = '{m}' THEN 2 * low - mid END) AS low_{m}" for m, _, below in SHARES if below]
    return f"""{name} AS (SELECT {group}max(total) AS total, {", ".join(cols)}
  FROM (SELECT {group}measure, max(total)::DOUBLE AS total, min(CASE WHEN 2 * up_to >= total THEN bucket END)::DOUBLE AS mid,
      min(CASE WHEN above * up_to >= (above - 1) * total THEN bucket END)::DOUBLE AS high, min(CASE WHEN below * up_to >= total THEN bucket END)::DOUBLE AS low
    FROM (SELECT {group}measure, bucket, {case(1)} AS above, {case(2)} AS below,
        sum(n) OVER (PARTITION BY {part}measure ORDER BY bucket) AS up_to, sum(n) OVER (PARTITION BY {part}measure) AS total
      FROM (SELECT {group}measure, bucket, sum(n) AS n FROM {source} GROUP BY {group}measure, bucket)) GROUP BY {group}measure)
  {f"GROUP BY {by}" if by else ""})"""


def _repeats_sql(name: str, source: str) -> str:
    """name (doc_id, n): words of source (doc_id, words) that lie in eight-word windows found twice."""
    gram = " || ' ' || ".join(f"lead(word, {k}) OVER win" for k in range(8))
    return f"""{name}_w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM {source}),
{name}_g AS (SELECT doc_id, pos, {gram} AS gram FROM {name}_w WINDOW win AS (PARTITION BY doc_id ORDER BY pos)),
{name}_t AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM {name}_g WHERE gram IS NOT NULL) WHERE times > 1),
{name} AS (SELECT doc_id, sum(least(8, coalesce(next - pos, 8)))::BIGINT AS n
  FROM (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM {name}_t) GROUP BY doc_id)"""


_K = _weights(SHARES)
_LANG = ", ".join(f"(l.total * l.{c} + {k}::DOUBLE * a.{c}) / (l.total + {k}::DOUBLE) AS {c}" for c, k in _K.items())
_OWN = ", ".join(f"(own.total * own.{c} + {k}::DOUBLE * lang_fence.{c}) / (own.total + {k}::DOUBLE) AS {c}" for c, k in _K.items())
_BUCKET = "CASE WHEN {0} < 64 THEN {0} ELSE ({0} >> (length(bin({0})) - 6)) << (length(bin({0})) - 6) END"
_OK = " AND ".join(f"{_BUCKET.format(c.split('_')[1])} {'<=' if c.startswith('high') else '>='} {c}" for c in _K)

ORACLE = rf"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
  regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS words FROM documents),
{_repeats_sql("r", "d")},
lines AS (SELECT doc_id, line, count(*) AS times, min(pos) AS pos FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d) WHERE regexp_matches(line, '[^ 	-]') GROUP BY doc_id, line),
dup AS (SELECT doc_id, sum(times - 1)::BIGINT AS n_dup_lines, string_agg(line, chr(10) ORDER BY pos) AS once FROM lines GROUP BY doc_id),
again AS (SELECT doc_id, regexp_extract_all(once, '[^ 	-]+') AS words FROM dup JOIN r USING (doc_id) WHERE n_dup_lines > 0 AND r.n > 0),
{_repeats_sql("f", "again")},
c AS (SELECT d.doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words, (CASE WHEN coalesce(n_dup_lines, 0) > 0 THEN coalesce(f.n, 0) ELSE coalesce(r.n, 0) END)::BIGINT AS n_fresh_repeats
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN f USING (doc_id)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, 1000 * n_symbols // greatest(word_chars, 1) AS symbols,
  1000 * n_fresh_repeats // greatest(n_words, 1) AS repeats, 1000 * n_dup_lines // greatest(n_words, 1) AS lines, 100 * word_chars // greatest(n_words, 1) AS length FROM c),
m AS (SELECT lang, source, unnest(['symbols', 'repeats', 'lines', 'length']) AS measure, unnest([symbols, repeats, lines, length]) AS value FROM v WHERE NOT base_failed),
b AS (SELECT lang, source, measure, {_BUCKET.format("value")} AS bucket, count(*) AS n FROM m GROUP BY ALL),
{_fence_sql("own", "b", "lang, source")},
{_fence_sql("by_lang", "b", "lang")},
{_fence_sql("of_all", "b", "")},
lang_fence AS (SELECT l.lang, {_LANG} FROM by_lang AS l, of_all AS a),
fence AS (SELECT own.lang, own.source, {_OWN} FROM own JOIN lang_fence USING (lang))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_fresh_repeats, base_failed, NOT base_failed AND coalesce({_OK}, true) AS kept
FROM v LEFT JOIN fence USING (lang, source)"""
