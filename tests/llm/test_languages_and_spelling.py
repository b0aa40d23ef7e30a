import random
import string
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import DATA

from pulsegrid.llm import language_id, spelling
from pulsegrid.llm.queries import QUERIES

# --- languages ------------------------------------------------------------------------------------

ODD = [None, "", "  12 % 3\n", "é", "Été, déjà vu!", "ÀB1c", "Ώx", "aaa " * 400, "\U0001f600 mixed 日本 text", "İI i", "́"]


def plain_counts(text, bits):
    low, kept = text.lower(), " "
    for ch in low:
        ch = ch if unicodedata.category(ch)[0] in "LM" else " "
        if ch != " " or kept[-1] != " ":
            kept += ch
    kept += " " if kept[-1] != " " else ""
    out, mask = Counter(), 2**64 - 1
    for n in range(1, 5):
        for k in range(len(kept) - n + 1):
            if n == 1 and k == 0:
                continue  # the space put before the text
            h = 0
            for m in range(1, n + 1):
                h = (((h + m) * 0x100000001B3) & mask) ^ ord(kept[k + m - 1])
            out[((h * 0x9E3779B97F4A7C15) & mask) >> (64 - bits)] += 1
    return out


@pytest.mark.parametrize("window", [1, 2, 3, 7, 1 << 20])
def test_buckets_are_those_of_a_plain_loop(window):
    for text in filter(None, ODD):
        got = language_id.bucket_counts(text, 12, window)
        assert {int(k): int(got[k]) for k in np.flatnonzero(got)} == dict(plain_counts(text, 12)), text


def test_languages_against_plain_bayes(spark, docs_of):
    learn = [(1, "the cat sat", "en"), (2, "le chat noir", "fr"), (3, "the dog", "en"), (3, "the dog", "en"), (4, None, "xx"), (5, "12", "xx"), (6, "sans lang", None), (7, "vide", "")]
    model = language_id.fit(docs_of(*learn), bits=10)
    assert model.languages == ["", "en", "fr"]
    tables, n_docs = {}, Counter()
    for _, t, v in learn:
        if t and v is not None and any(map(str.isalpha, t)):
            tables.setdefault(v, Counter()).update(plain_counts(t, 10))
            n_docs[v] += 1
    ask = [(k, t) for k, t in enumerate([*ODD, "the chat", "noir dog", "vid"])]
    got = language_id.predict(docs_of(*ask), model).collect()
    assert [r.doc_id for r in got] == [k for k, _ in ask]
    for r, (_, t) in zip(got, ask):
        if not t or not any(map(str.isalpha, t)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        logs = {v: np.log(n_docs[v] / sum(n_docs.values())) + sum(n * np.log((tables[v][b] + 0.5) / (sum(tables[v].values()) + 0.5 * 1024)) for b, n in plain_counts(t, 10).items()) for v in sorted(tables)}
        best = max(logs, key=lambda v: logs[v])
        assert r.lang_pred == best
        assert r.score == pytest.approx(1 / sum(np.exp(x - logs[best]) for x in logs.values()))


def test_language_query_is_right_on_held_out_texts(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()}
    got = QUERIES["op11_language_id"](spark, f"{DATA}/sf0.01").collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and docs[r.doc_id].lang]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) >= 0.99


def test_labels_and_ids_are_no_inputs(spark, docs_of):
    model = language_id.fit(docs_of((1, "the cat", "en"), (2, "le chat", "fr")))
    a, b = (language_id.predict(docs_of((k, "the chat", v, s)), model).first() for k, v, s in ((5, "fr", "x"), (6, "en", None)))
    assert (a.lang_pred, a.score) == (b.lang_pred, b.score)


def test_language_edge_tables(spark, docs_of):
    none = docs_of().limit(0)
    empty = language_id.fit(none)
    assert empty.languages == []
    assert [(r.lang_pred, r.score) for r in language_id.predict(docs_of((1, "the cat")), empty).collect()] == [("und", 0.0)]
    model = language_id.fit(docs_of((1, "the cat", "en"), (2, "le chat", "fr")))
    assert language_id.predict(none, model).collect() == []
    clash = docs_of((1, "the cat"), (1, "the cat"), (None, None)).selectExpr("doc_id", "text", "'old' AS lang_pred", "7 AS Score")
    out = language_id.predict(clash, model)
    assert out.columns == ["doc_id", "text", "lang_pred", "score"]
    assert sorted(r.lang_pred for r in out.collect()) == ["en", "en", "und"]
    with pytest.raises(ValueError):
        language_id.fit(docs_of((1, "a", "x"), (2, "b", "y")), most_languages=1)


# --- spelling -------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(docs, ratio=5):
    import regex

    counts = Counter()
    for key, text in docs:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 5}
    near = {w: [] for w in words}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for w in words:
        for k in (len(w), len(w) + 1):
            for u in by_length.get(k, ()):
                if one_edit(w, u):
                    near[w].append(u)
                    if k > len(w):
                        near[u].append(w)
    form = {}
    for w, n in words.items():
        if near[w]:
            u = min(near[w], key=lambda u: (-words[u], u))
            if words[u] >= ratio * n:
                form[w] = u
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None)
    return out


def as_dict(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_spelling_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()]
    assert as_dict(QUERIES["op13_spelling"](spark, f"{DATA}/sf0.001")) == plain_variants(docs)


@pytest.mark.parametrize("crowded", [1, 3, 64])
def test_crowded_keys_lose_and_repeat_no_pair(spark, docs_of, crowded):
    rng = random.Random(5)
    words = {"".join(rng.choice("abÿ") for _ in range(rng.choice((6, 7, 8)))) for _ in range(500)}
    words |= {"".join(rng.sample("abcdef", 6)) + rng.choice(string.ascii_lowercase) for _ in range(300)}
    docs = [(k, " ".join([w] * rng.choice((5, 6, 30, 151)))) for k, w in enumerate(sorted(words))]
    got = as_dict(spelling.variants(docs_of(*docs), crowded=crowded))
    assert got == plain_variants(docs)
    assert sum(v[3] for v in got.values()) > 1000


def test_roots_follow_forms_to_the_last(spark, docs_of):
    chain = ["abcdefgh", "abcdefg", "abcdef", "abcdxf", "abcyxf"]
    docs = [(k, f"{w.upper() if k % 2 else w} " * 5 * 5 ** (len(chain) - k)) for k, w in enumerate(chain)]
    got = as_dict(spelling.variants(docs_of(*docs)))
    assert got == plain_variants(docs)
    assert {v[1] for v in got.values()} == {"abcdefgh"} and got["abcyxf"][0] == "abcdxf"


def test_differences_of_letters_are_all_different():
    letters = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
    values = [c**spelling.POWER for c in letters]
    assert len({a - b for a in values for b in values if a != b}) == len(letters) * (len(letters) - 1)
    assert max(values) * 90 < spelling._MODULUS


def test_spelling_edge_cases(spark, docs_of):
    docs = [(1, None), (None, "Éclair×÷ " * 6), (2, ""), (3, "kurz " * 9), (4, "Éclair×÷ ÉCLAIR×÷"), (4, "Éclair×÷ ÉCLAIR×÷"), (5, "word_words wordsé日words " * 5), (6, "x" * 100_000 + " " + "y" * 70_000)]
    clash = docs_of(*docs).selectExpr("doc_id", "text", "1 AS word", "2 AS n", "3 AS key")
    assert as_dict(spelling.variants(clash)) == plain_variants(docs)
    assert spelling.variants(docs_of().limit(0)).collect() == []
    long = [(k, ("ab" * 3000 + "c") + " " + ("ab" * 3000 + "d")) for k in range(6)]
    assert as_dict(spelling.variants(docs_of(*long), crowded=1)) == plain_variants(long)
    with pytest.raises(ValueError):
        spelling.variants(docs_of((1, "a")), ratio=1)
