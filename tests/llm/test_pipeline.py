"""The pipeline's stages, each against a plain version of what it does to its own input."""

import numpy as np
import public_tokenizers as P
from compare import DATA
from test_models import brute_counts
from test_near_duplicates import brute_lines, brute_print, roots
from tokenizers import Tokenizer

import corpus_pipeline

FOLDER = f"{DATA}/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    frames = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], FOLDER).write.parquet(str(tmp_path / str(k)))
        frames.append(spark.read.parquet(str(tmp_path / str(k))))
    rows = [{r.doc_id: r.text for r in f.collect()} for f in frames[:-1]]
    for f in frames[1:-1]:
        assert sorted(f.columns) == sorted(docs.columns)
    # Classifier: clean documents stay, texts don't change.
    gone = rows[0].keys() - rows[1].keys()
    assert all(labels[d] == 0 for d in gone if d in labels) and all(rows[0][d] == t for d, t in rows[1].items())
    # Rules: what the base rules reject goes.
    for d, t in rows[1].items():
        n, _, _, _, repeats = brute_counts(t)
        if n < 20 or 100 * repeats > 30 * n:
            assert d not in rows[2]
    assert all(rows[1][d] == t for d, t in rows[2].items())
    # Lines.
    assert rows[3] == brute_lines(list(rows[2].items()))
    # One of each group stays.
    ids = sorted(rows[3])
    prints = [brute_print(rows[3][d]) for d in ids]
    at = roots(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    assert rows[4] == {ids[k]: rows[3][ids[k]] for k in set(at)}
    # Sequences.
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces = frames[-1].toPandas().sort_values(["doc_id", "start"])
    assert set(pieces.doc_id) == set(rows[4])
    for d, p in pieces.groupby("doc_id"):
        n = len(t.encode(rows[4][d], add_special_tokens=False).ids) + 1
        assert (p.start.to_numpy() == np.concatenate([[0], np.cumsum(p.length)[:-1]])).all() and p.length.sum() == n and set(p.doc_tokens) == {n}
    sizes = pieces.groupby("sequence_id").length.sum()
    assert sizes.max() <= 4096 and ((sizes & (sizes - 1)) == 0).all()


def test_run(spark):
    assert corpus_pipeline.run(spark, f"{DATA}/sf0.001").count() > 0


def test_stages_on_odd_rows(spark, corpus, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, one id with two texts, clashing names, no rows."""
    some = [tuple(r) for r in corpus.limit(40).collect()]
    kind = corpus.schema
    odd = [some[0], some[0], (some[1][0], some[2][1], *some[2][2:]), (None,) * len(kind), (None, *some[3][1:]), (9_000_001, "", None, None, 0), (9_000_002, some[4][1] * 30, "en", None, None)]
    docs = spark.createDataFrame(some + odd, kind)
    for c in ("score", "kept", "n_words", "q_lang", "text_hash", "doc_tokens", "sim_id", "quality_score"):
        docs = docs.withColumn(c, docs.doc_id)
    for name, frame in (("rows", docs), ("none", docs.limit(0))):
        rest = frame
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, rest, f"{DATA}/sf0.001").write.parquet(f"{tmp_path}/{name}{k}")
            rest = spark.read.parquet(f"{tmp_path}/{name}{k}")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert rest.columns == docs.columns
        assert (rest.count() > 0) == (name == "rows")
