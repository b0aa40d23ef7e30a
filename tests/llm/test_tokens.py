import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pulsegrid.llm import byte_bpe, common, packing, token_files

ODD = ["", "a", " \n\t ", "É É Ḣ x̱ ß İ Σας ΟΔΟΣ. ½ a b c\x1cd", "don't DON'T 'S I'm <|endoftext|> [x].y -- a's 12ab3 ｶﾞ \U0001f600é", "​ a ‍ b　c", "x" * 3000, "word, " * 500]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def tik():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name,folds", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True), ("word_bpe_49k.json", False)])
def test_units_give_the_library_ids(corpus, name, folds):
    common._ENCODERS.clear()
    e = common.json_encoder(P.path(name), folds)
    e.most = 2000  # generations change often
    for s in ODD + [r.text for r in corpus.limit(150).collect()]:
        assert np.frombuffer(e.encode(s), "<u4").tolist() == e.tokenizer.encode(s, add_special_tokens=False).ids
    common._ENCODERS.clear()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"aB é́'.,!#\t\n \xa0\x1c1½ßΣİJ̌_\U0001f600", "<|endoftext|>", "<|startoftext|>", "'re", "word"]), max_size=30).map("".join), max_size=5))
def test_units_on_any_text(texts):
    """Each text of a column, alone and in company, against the library's plain call."""
    for name, folds in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        e, library = common.json_encoder(P.path(name), folds), Tokenizer.from_file(P.path(name))
        want = [library.encode(s, add_special_tokens=False).ids for s in texts]
        assert [np.frombuffer(e.encode(s), "<u4").tolist() for s in texts] == want
        for most in (1, 20, 1 << 23):
            got = [ids[a:b].tolist() for _, ids, bounds in e.parts(pa.array(texts, pa.string()), most_bytes=most) for a, b in zip(bounds, bounds[1:])]
            assert got == want
        ended = [ids[a:b].tolist() for _, ids, bounds in e.parts(pa.array([None, *texts], pa.string()), 2) for a, b in zip(bounds, bounds[1:])]
        assert ended == [[2], *(w + [2] for w in want)]


@pytest.mark.parametrize("name,folds", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_plain_words_share_calls(name, folds):
    """Thousands of new words take few texts of the library's, and each gets its own ids."""
    letters, rng = list("abcdefghijklmnopqrstuvwxyz" + "éßÀÿ" * (not folds)), np.random.default_rng(5)
    words = ["".join(rng.choice(letters, 1 + k % 9)) for k in range(3000)]
    text, sent = " " + " ".join([*words, "×", " 1÷2 ", "don't"]), []

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def __getattr__(self, key):
            return getattr(self.tokenizer, key)

        def encode_batch_fast(self, texts, **options):
            sent.extend(texts)
            return self.tokenizer.encode_batch_fast(texts, **options)

    common._ENCODERS.clear()
    e = common.json_encoder(P.path(name), folds)
    library, e.tokenizer = e.tokenizer, Counted(e.tokenizer)
    e.bare = e.bare and Counted(e.bare)
    assert np.frombuffer(e.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    common._ENCODERS.clear()
    assert len(sent) < len(set(words)) / 10


def test_special_spellings():
    """The plain call takes an added token's spelling for that token."""
    e = common.json_encoder(P.path("byte_bpe_50k.json"))
    assert np.frombuffer(e.encode("a<|endoftext|>"), "<u4").tolist()[-1] == 50256
    e = common.json_encoder(P.path("word_bpe_49k.json"), True)
    assert np.frombuffer(e.encode("<|startoftext|> a"), "<u4").tolist()[0] == 49406
    assert np.frombuffer(e.encode("İ."), "<u4").tolist() == [328, 136, 229, 269]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_packing_of_bits(bits, values):
    ids = np.array([v % 2**bits for v in values], "<u4")
    data = token_files.pack(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8)
    assert (token_files.unpack(data, bits, len(ids)) == ids).all()


@pytest.mark.parametrize("vocabulary,block", [(50_257, 4096), (50_257, 7), (70_000, 5), (2, 3)])
def test_random_access(tmp_path, vocabulary, block):
    bits, rng = token_files.width(vocabulary), np.random.default_rng(0)
    docs = [rng.integers(0, vocabulary, n).astype("<u4") for n in (3, 0, 1000, 1, 17)]
    path = tmp_path / "x.tok"
    with open(path, "wb") as f:
        w = token_files.Writer(f, bits, block)
        w.add([None, 1], np.concatenate(docs[:2]), np.array([0, 3, 3]))
        for k, d in enumerate(docs[2:], 2):
            w.add([k], d, np.array([0, len(d)]))
        w.close()
    everything = np.concatenate(docs)
    with open(path, "rb") as f:
        r = token_files.Reader(f)
        assert (r.n, r.n_docs, r.docs[0]) == (1021, 5, token_files.NULL_ID)
        assert all((r.document(k) == d).all() for k, d in enumerate(docs))
        for a, b in ((0, 1021), (5, 6), (1000, 1021), (3, 3), (0, 5000)):
            assert (r.ids(a, b) == everything[a:b]).all()


def test_token_files_round_trip(spark, docs_of, tmp_path, plain):
    rows = [(5, "five five"), (1, None), (9, ""), (None, "no id"), (3, "long " * 4000), (5, "five again"), (7, "ünïcödé \U0001f600")]
    docs = docs_of(*rows).repartition(3)
    files = token_files.write(docs, str(tmp_path / "f"), P.path("byte_bpe_50k.json"), 50_257, 2, partitions=3)
    got = [r.asDict() for r in token_files.read(files, ids=True).orderBy("start").collect()]
    assert [r["doc_id"] for r in got] == [None, 1, 3, 5, 5, 7, 9]
    want = {None: ["no id"], 1: [""], 3: ["long " * 4000], 5: ["five again", "five five"], 7: ["ünïcödé \U0001f600"], 9: [""]}
    start = 0
    for r in got:
        ids = np.array(plain.encode(want[r["doc_id"]].pop(0), add_special_tokens=False).ids + [2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) == (start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)
    empty = token_files.write(docs.limit(0), str(tmp_path / "g"), P.path("byte_bpe_50k.json"), 50_257, 2)
    assert token_files.read(empty).count() == 0


def test_rows_without_id_are_split_among_files(spark, docs_of, tmp_path, plain):
    """Ten thousand rows without doc_id lie in several files, in the order of their texts."""
    texts = [f"{k * 7919 % 10_000:05d} words of no document" for k in range(10_000)]
    docs = docs_of(*[(None, t) for t in texts], (4, "four")).repartition(6)
    files = token_files.write(docs, str(tmp_path / "f"), P.path("byte_bpe_50k.json"), 50_257, 2, partitions=8)
    listed = files.orderBy("file").collect()
    assert len(listed) >= 6 and max(f.n_docs for f in listed) < 4000 and sum(f.n_docs for f in listed) == 10_001
    assert all(f.path.startswith("file:///") for f in listed)
    got = token_files.read(files).orderBy("start").collect()
    start = 0
    for r, t in zip(got, [*sorted(texts), "four"], strict=True):
        ids = np.array(plain.encode(t, add_special_tokens=False).ids + [2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (4 if t == "four" else None, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_paths_are_qualified_and_sizes_make_files(spark, tmp_path):
    assert token_files.qualified(spark, str(tmp_path / "a b")) == "file://" + str(tmp_path) + "/a%20b"
    assert token_files.qualified(spark, "file:" + str(tmp_path)) == "file://" + str(tmp_path)
    with pytest.raises(ValueError, match="viewfs"):
        spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.t.link./x", "file:///tmp")
        token_files.qualified(spark, "viewfs://t/x")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert token_files.file_number(docs, 1 << 40) == [] and token_files.file_number(docs, 1 << 10)[0] > 100


def test_token_file_query(spark, plain):
    from pulsegrid.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op5_token_files"](spark, "/root/testdata/sf0.001").collect()}
    start = 0
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect():
        ids = np.array(plain.encode(r.text, add_special_tokens=False).ids + [2], "<u4")
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_byte_bpe_query(spark, tik):
    from pulsegrid.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op6_byte_bpe"](spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = tik.encode_ordinary(r.text)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_byte_bpe_matches_ranks_on_odd_texts(tik):
    _, e = byte_bpe.loaded(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for s in ODD:
        assert np.frombuffer(e.encode(s), "<u4").tolist() == tik.encode_ordinary(s)


def test_byte_bpe_columns(spark, docs_of, tik):
    docs = docs_of((1, "héllo \U0001f600 wörld"), (2, None), (3, "")).withColumnRenamed("lang", "ids").withColumnRenamed("source", "decoded")
    path = P.path("byte_bpe_50k.tiktoken")
    enc = byte_bpe.encode(docs, path, P.PATTERN, offsets="offsets")
    dec = {r.doc_id: r for r in byte_bpe.decode(enc, path, tokens="pieces").collect()}
    assert dec[1].decoded.decode() == "héllo \U0001f600 wörld" and "".join(dec[1].pieces) == "héllo \U0001f600 wörld"
    assert dec[2].decoded == b"" and dec[2].text is None and dec[3].ids == b""
    ids = tik.encode_ordinary("héllo \U0001f600 wörld")
    assert np.frombuffer(dec[1].ids, "<u4").tolist() == ids and len(dec[1].offsets) == len(ids) and dec[1].offsets[0] == 0
    trip = byte_bpe.round_trip(docs.withColumn("n_tokens", docs.doc_id), path, P.PATTERN)
    assert {r.doc_id: r.n_tokens for r in trip.collect()} == {1: len(ids), 2: 0, 3: 0}
    assert byte_bpe.pieces([b"\xf0\x9f", b"\x98\x80", b"\xff"]) == ["", "\U0001f600", "�"]


def _pieces(rows, lengths):
    """Checks that pieces cover each document once and each sequence without gaps; the sequences' lengths."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, n in lengths.items():
        at = 0
        for start, length, total in sorted(by_doc[doc]):
            assert start == at and total == n and length > 0
            at += length
        assert at == n
    sizes = []
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        sizes.append(at)
    return sizes


def test_packing(spark, docs_of):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = {1: "a b c", 2: None, 3: "word " * 9000, 4: "", 5: "the end " * 1300, 6: "x " * 511, 7: "x " * 4095}
    docs = docs_of(*texts.items()).coalesce(1)
    rows = packing.pack(docs, P.path("word_bpe_49k.json"), 2, True).collect()
    ids = {k: np.array(t.encode(s or "", add_special_tokens=False).ids + [2], "<u4") for k, s in texts.items()}
    sizes = _pieces(rows, {k: len(v) for k, v in ids.items()})
    assert max(sizes) == 4096 and all(n & (n - 1) == 0 for n in sizes)
    for r in rows:
        assert r.ids == ids[r.doc_id][r.start : r.start + r.length].tobytes()
    assert packing.pack(docs.limit(0), P.path("word_bpe_49k.json"), 2).count() == 0
    for r in packing.packed(docs).collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())


def test_packing_of_repeated_ids_and_clashing_names(spark, docs_of):
    docs = docs_of((1, "a b c"), (1, "a b c"), (1, "d"), (None, "e")).withColumnRenamed("lang", "start").withColumnRenamed("source", "ids").coalesce(1)
    rows = packing.packed(docs).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in rows if r.start == 0) == [(0, 2), (1, 2), (1, 4), (1, 4)]
    assert sum(r.length for r in rows) == 12


def test_byte_bpe_of_long_texts_and_no_rows(spark, docs_of, tik):
    path, long = P.path("byte_bpe_50k.tiktoken"), "long words, and İ. " * 20_000
    r = byte_bpe.round_trip(docs_of((1, long)), path, P.PATTERN).first()
    assert r.n_tokens == len(tik.encode_ordinary(long)) and r.decoded_sha256 == hashlib.sha256(long.encode()).hexdigest()
    empty = docs_of((1, "")).limit(0)
    assert byte_bpe.round_trip(empty, path, P.PATTERN).count() == 0 and byte_bpe.decode(byte_bpe.encode(empty, path, P.PATTERN), path).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=60), st.integers(1, 20))
def test_packer(lengths, at_once):
    p = packing.Packer()
    for k in range(0, len(lengths), at_once):
        p.add([(i, n) for i, n in enumerate(lengths[k : k + at_once], k)])
    p.end()
    out = p.take()
    got = {}
    for s in out:
        n = sum(b - a for _, a, b in s)
        assert n & (n - 1) == 0 and n <= 4096
        for d, a, b in s:
            got.setdefault(d, []).append((a, b))
    for i, n in enumerate(lengths):
        at = 0
        for a, b in sorted(got[i]):
            assert a == at < b
            at = b
        assert at == n


def test_step_groups_are_balanced(spark, corpus):
    rows = packing.pack(corpus.coalesce(1), P.path("word_bpe_49k.json"), 2, True, step_tokens=8192, at_once=20_000).groupBy("step_group").sum("length").collect()
    sizes = sorted(r[1] for r in rows)
    assert all(n == 8192 for n in sizes[1:])
