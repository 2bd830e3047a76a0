"""Tokenizer operators against the libraries, and the binary format as an exact round trip."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docquarry.llm import pieces, token_store, transducer, tree_bpe

BYTE_JSON, MULTI, WORD_JSON = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"))
TEXTS = [None, "", " ", "a", "it's 'twas they'll we're I'd''s", "x" * 5000, "ab" * 3000 + " end", "a  b\n\n c\t\t", "é è ü ß 한국어 日本", "<|endoftext|>", "one<|endoftext|>two <|startoftext|>", "12 345 ٣٤", "\x1c\x85 z", "The quick, brown fox!" * 50, "́é İI ΑΣ ΣΑ"]
ALPHABET = ["a", "B", " ", "  ", "\n", "'", "s", "'re", "'LL", "é", "7", "!", "the", "　", "x" * 60, "한", "'v", "e", "ing", "<|", "\x85", "Σ"]


def batch(texts):
    encoded = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(encoded), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in encoded])]).astype(np.int64)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    return TEXTS + ["".join(r.choices(ALPHABET, k=r.randint(0, 40))) for _ in range(400)]


def test_tree_bpe_equals_the_library(library, texts):
    ids, counts = tree_bpe.encode_texts(*batch(texts), MULTI)
    want = [library.encode_ordinary(t or "") for t in texts]
    assert counts.tolist() == list(map(len, want))
    assert ids.tolist() == [i for w in want for i in w]


def test_decoding_gives_the_bytes_back(texts):
    for t in texts:
        ids, _ = tree_bpe.encode_texts(*batch([t]), MULTI)
        assert tree_bpe.decode(ids, MULTI, leaf=3) == (t or "").encode()


@pytest.mark.parametrize("leaf", [1, 2, 5, 17])
def test_text_trees_cut_where_the_pattern_does(texts, leaf):
    for t in texts:
        data, offsets = batch([t])
        whole = pieces.split_pieces(data, offsets)[0]
        if len(data) < 200:
            assert tree_bpe.TreeText(leaf).starts(data).tolist() == whole.tolist()


def test_halves_of_long_pieces_join(library):
    bpe, _ = tree_bpe.rank_coder(MULTI)
    r = random.Random(3)
    for n in (33, 64, 100, 1000, 20_000):
        for letters in ("a", "ab", "abcdefgh", "thein"):
            text = "".join(r.choices(letters, k=n))
            assert bpe.encode_piece(text.encode()) == library.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_tree_bpe_on_any_text(library, text):
    ids, _ = tree_bpe.encode_texts(*batch([text.encode("utf-8", "ignore").decode()]), MULTI)
    assert ids.tolist() == library.encode_ordinary(text.encode("utf-8", "ignore").decode())


def test_transducer_counts_equal_the_library(texts):
    tokenizer = Tokenizer.from_file(WORD_JSON)
    assert transducer.count_tokens([t or "" for t in texts], WORD_JSON).tolist() == [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_transducer_forgets_and_compiles_again():
    made, _ = transducer.compiled_tokenizer(WORD_JSON)
    before = transducer.count_tokens(["some words here"], WORD_JSON).tolist()
    made.forget()
    assert transducer.count_tokens(["some words here"], WORD_JSON).tolist() == before


@pytest.mark.parametrize("values", [[], [0], [5] * 256, list(range(1000)), [2**32 - 1, 0] * 300, [7] * 255 + [2**31]])
def test_blocks_round_trip(values):
    made = np.array(values, np.uint32)
    data, starts = token_store.pack_blocks(made)
    assert token_store.unpack_blocks(data, starts)[: len(made)].tolist() == values


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 60_000), max_size=700))
def test_blocks_round_trip_on_any_ids(values):
    data, starts = token_store.pack_blocks(np.array(values, np.uint32))
    assert token_store.unpack_blocks(data, starts)[: len(values)].tolist() == values


def test_token_files(spark, tmp_path):
    rows = [(i * 3 % 50, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (7, "again"), (7, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1)})
    files = token_store.write_tokens(docs, f"file://{tmp_path}", BYTE_JSON)
    got = sorted(map(tuple, token_store.read_tokens(files).collect()), key=lambda r: r[1])
    tokenizer = Tokenizer.from_file(BYTE_JSON)
    at, want = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_any_id_is_found_by_its_block(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i} " * 30) for i in range(40)], "doc_id long, text string").coalesce(1)
    uri = token_store.write_tokens(docs, f"file://{tmp_path}", BYTE_JSON).orderBy("shard").first().uri
    file = token_store.TokenFile(uri)
    whole = file.ids(0, file.n_ids)
    assert file.ids(300, 310).tolist() == whole[300:310].tolist() and len(whole) == file.n_ids


def test_no_rows(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_store.read_tokens(token_store.write_tokens(none, f"file://{tmp_path}", BYTE_JSON)).count() == 0
    assert tree_bpe.encode_documents(none, MULTI).count() == 0
    assert transducer.token_counts(none, WORD_JSON).count() == 0


def test_frames_keep_rows_and_ignore_other_columns(spark, library):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, None)], "doc_id long, text string, n_tokens string")
    got = sorted(tree_bpe.encode_documents(docs, MULTI, digest=True).collect(), key=lambda r: r.doc_id or 0)
    ids = library.encode_ordinary("a b")
    assert [r.n_tokens for r in got] == [0, 2, 2]
    assert got[1].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert got[0].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    counted = sorted(transducer.token_counts(docs, WORD_JSON, limit=1).collect(), key=lambda r: r.doc_id or 0)
    assert [(r.n_bytes, r.n_tokens, r.over_limit) for r in counted] == [(0, 0, False), (3, 2, True), (3, 2, True)]
    assert [r.ids for r in tree_bpe.encode_documents(docs.filter("doc_id = 1"), MULTI).collect()] == [ids, ids]


def test_long_words_are_composed():
    r = random.Random(6)
    library = Tokenizer.from_file(WORD_JSON)
    texts = ["a" * 20_000, "ab" * 9_000, "".join(r.choices("etaoinshrdlu", k=30_000)), "word " * 500 + "z" * 5_000 + " end", "".join(r.choices("abcde", k=700)) * 8]
    assert transducer.count_tokens(texts, WORD_JSON).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
