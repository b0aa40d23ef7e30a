import numpy as np
import pytest
import xxhash
from compare import DATA
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrid.llm import cap_filters, common, line_dedup, simhash
from pulsegrid.llm.queries import QUERIES


def roots(n, pairs):
    """The least index that pairs reach, by brute force."""
    at = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(at[a], at[b])
            if (at[a], at[b]) != (low, low):
                at[a] = at[b] = low
                changed = True
    return at


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))] + [(k, k + 1) for k in range(300, 380)] + [(500, k) for k in range(400, 500)] + [(7, 7)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    want = roots(501, pairs)
    assert all(got[n] == want[n] for n in got) and {n for p in pairs for n in p if p[0] != p[1]} == set(got)
    assert common.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# --- fingerprints ---------------------------------------------------------------------------------


def brute_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \n", "one", "one two", "One TWO three", "a b c d e f g", "É é E " * 50, "w " * 70_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_print(text)


def test_simhash_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op8_simhash"](spark, f"{DATA}/sf0.01").collect()}
    prints = {r.doc_id: brute_print(r.text) for r in docs}
    assert {k: r.fingerprint for k, r in got.items()} == {k: f"{p:016x}" for k, p in prints.items()}
    ids = sorted(prints)
    pairs = [(i, j) for i in range(len(ids)) for j in range(i) if (prints[ids[i]] ^ prints[ids[j]]).bit_count() <= 2]
    want = roots(len(ids), pairs)
    assert all(got[d].component_id == ids[want[k]] for k, d in enumerate(ids))


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=2))
def test_near_fingerprints_share_a_cell(x, flips):
    y = x
    for b in flips:
        y ^= 1 << b
    c = simhash.cells(np.array([x, y], np.uint64).view(np.int64))
    assert set(c[0]) & set(c[1])


@pytest.mark.parametrize("small,block", [(64, 2048), (2, 4)])
def test_links_connect_crowded_cells(spark, small, block):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 5)
    prints = np.unique([int(b) ^ int(sum(1 << int(k) for k in rng.choice(40, rng.integers(0, 4), False))) for b in base for _ in range(30)])
    df = spark.createDataFrame([(int(p),) for p in prints], "fingerprint long")
    edges = [(int(np.searchsorted(prints, r.a)), int(np.searchsorted(prints, r.b))) for r in simhash.links(df, small=small, block=block).collect()]
    want = [(i, j) for i in range(len(prints)) for j in range(i) if (int(prints[i]) ^ int(prints[j])).bit_count() <= 2]
    assert all((int(prints[a]) ^ int(prints[b])).bit_count() <= 64 for a, b in edges)
    assert roots(len(prints), edges) == roots(len(prints), want)


def test_simhash_cases(spark, docs_of):
    docs = docs_of((3, "a b c d"), (1, "A b C d"), (2, None), (4, ""), (5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "other words entirely here"))
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted([(3, 1), (1, 1), (2, 2), (4, 2), (5, 1), (5, 1), (None, 1), (None, None)], key=str)
    kept = simhash.stage(spark, docs.withColumnRenamed("lang", "sim_id").withColumnRenamed("source", "sim_text"), "")
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, "A b C d"), (2, None), (None, "other words entirely here")], key=str)
    assert kept.columns == ["doc_id", "text", "sim_id", "sim_text", "n_chars"]
    assert simhash.stage(spark, docs.limit(0), "").count() == 0
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("order", [(0, 1, 2), (0, 2, 1), (2, 1, 0), (1, 0, 2)])
def test_stage_keeps_unique_texts_of_a_repeated_id(spark, docs_of, order):
    rows = [(3, "b b1 b2 b3 b4"), (5, "b b1 b2 b3 b4"), (5, "a text of its own, found nowhere else")]
    kept = simhash.stage(spark, docs_of(*(rows[k] for k in order)).coalesce(1), "")
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [rows[0], rows[2]]


def test_cells_are_selective():
    """Of a million random fingerprints, few meet another in a cell at all."""
    p = np.random.default_rng(4).integers(-(2**63), 2**63, 1_000_000)
    keys = np.sort(np.concatenate([simhash.cells(q).ravel() for q in np.array_split(p, 20)]))
    _, n = np.unique(keys, return_counts=True)
    assert (n[n > 1] * (n[n > 1] - 1) // 2).sum() < 1_000


# --- embeddings -----------------------------------------------------------------------------------


def brute_vectors(ids, vectors, threshold=0.9):
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    link = u @ u.T >= threshold
    np.fill_diagonal(link, False)
    at = roots(len(ids), list(zip(*np.nonzero(np.triu(link)))))
    return {i: (int(link[k].sum()), ids[at[k]]) for k, i in enumerate(ids)}


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 64))
    v = np.concatenate([c + rng.standard_normal((12, 64)) * s for c, s in zip(centres, rng.uniform(0.05, 0.4, 40))] + [np.repeat(centres[:1], 30, 0), rng.standard_normal((200, 64))])
    rows = [(k, [float(x) for x in row], k % 3) for k, row in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")
    want = brute_vectors(list(range(len(v))), v)
    for block in (512, 16):
        got = {r.vec_id: (r.n_links, r.component_id) for r in cap_filters.near_duplicates(df.repartition(5), block=block).collect()}
        found, there = sum(x[0] for x in got.values()), sum(x[0] for x in want.values())
        assert found <= there and found >= 0.99 * there
        assert sum(got[k] == want[k] for k in want) >= 0.98 * len(want)


def test_recall_at_the_threshold():
    """Pairs of cosine exactly 0.9, the hardest ones."""
    rng = np.random.default_rng(3)
    u = rng.standard_normal((3000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    n = rng.standard_normal(u.shape)
    n -= (n * u).sum(1, keepdims=True) * u
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    near = 0.9 * u + np.sqrt(1 - 0.81) * n
    shared = [bool(set(a) & set(b)) for a, b in zip(cap_filters.filters_of(u), cap_filters.filters_of(near))]
    assert np.mean(shared) > 0.998


def test_embedding_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet").collect()
    got = {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op2_cap_filters"](spark, f"{DATA}/sf0.1").collect()}
    ids = [r.vec_id for r in sorted(rows)]
    assert got == brute_vectors(ids, np.array([r.embedding for r in sorted(rows)], float))


def test_embedding_cases(spark):
    e = [1.0, 2.0, 3.0]
    rows = [(1, e), (2, e), (2, e), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 3.0]), (7, [1.0, float("nan"), 3.0]), (8, [1.0, float("inf"), 3.0]), (9, [1.0, 2.0]), (None, e), (10, [1e300, 2e300, 3e300])]
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in cap_filters.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    alone = [(k, 0, k, True) for k in range(3, 10)]
    assert sorted(got, key=str) == sorted([(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (None, 4, 1, False), (10, 4, 1, False), *alone], key=str)
    assert cap_filters.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# --- lines ----------------------------------------------------------------------------------------


def near(a, b):
    """Whether one replaced, inserted or dropped word makes a of b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_lines(docs, words_per_edit=line_dedup.WORDS_PER_EDIT):
    """{doc_id: text} after dedup: a line goes if an earlier one is the same, or near and long enough."""
    seen, out = [], {}
    for doc, text in sorted(docs):
        kept = []
        for line in text.split("\n"):
            w = line.split()
            gone = bool(w) and any(w == s or (max(len(w), len(s)) >= words_per_edit and near(w, s)) for s in seen)
            kept += [] if gone else [line]
            if w:
                seen.append(w)
        out[doc] = "\n".join(kept)
    return out


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.lists(st.sampled_from("a b c d".split()), max_size=8), min_size=1, max_size=4), min_size=1, max_size=6))
def test_lines_against_brute_force(spark, docs_of, texts):
    docs = {k: "\n".join(" ".join(line) for line in t) for k, t in enumerate(texts)}
    for words in (line_dedup.WORDS_PER_EDIT, 1):
        got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs_of(*docs.items()), words_per_edit=words).collect()}
        assert got == brute_lines(list(docs.items()), words)


def test_words_are_compared(spark):
    """What keys would call near, is dropped only if its words are."""
    F = line_dedup.F
    lines = ["a b c d e", "a b X d e", "a b c d", "b c d e", "a b c d e f", "x a b c d e", "a c b d e", "e d c b a", "", "a b c d e"]
    df = spark.createDataFrame([(x.split(), y.split()) for x in lines for y in lines], "a array<string>, b array<string>")
    for r in df.withColumn("near", line_dedup.within_one_edit(F.col("a"), F.col("b"))).collect():
        assert r.near == near(r.a, r.b), r


def test_a_very_long_line(spark, docs_of):
    long = " ".join(f"w{k}" for k in range(50_000))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs_of((1, long), (2, long.replace("w500 ", "")), (3, long + " x y"))).collect()}
    assert got == {1: long, 2: "", 3: long + " x y"}


def test_line_cases(spark, docs_of):
    long = " ".join(f"w{k}" for k in range(3000))
    rows = [(1, "one two three four five six\n\nshort"), (2, "one two three XXX five six\nshort\nown line"), (3, "one two three four five six seven"), (4, "two three four five six"), (5, None), (6, ""), (7, long), (8, long.replace("w1500 ", "")), (8, long.replace("w1500 ", "")), (None, "short\nlast"), (9, "a  b\tc"), (10, "a b c")]
    docs = docs_of(*rows).withColumnRenamed("lang", "n_lines").withColumnRenamed("source", "drop_at")
    got = sorted(((r.doc_id, r.text, r.drop_at) for r in line_dedup.dedup_lines(docs).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert [r[:2] for r in got] == [(1, rows[0][1]), (2, "own line"), (3, ""), (4, ""), (5, None), (6, ""), (7, long), (8, ""), (8, ""), (9, "a  b\tc"), (10, ""), (None, "last")]
    assert {r[2] for r in got} == {"src0"}
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    counted = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs, counts=True).collect()}
    assert counted[2] == (3, 2) and counted[1] == (3, 0) and counted[6] == (1, 0)
