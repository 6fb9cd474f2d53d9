"""Packing, token files and token counts against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from noteweave.llm import encoding, packing, token_counts, token_files

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "a", "  two  blanks ", "It's the dog's, don't!", "tab\tand\n\nlines\r\n x", "a <|endoftext|>b  <|endoftext|>", "Élan vital über\u0301 straße", "日本語 テキスト 🙂🙂",
    "x" * 3000, "end.\nNext (3.14) 50% off ² Ⅷ\u00a0nbsp", "the the the", "the the the", "word " * 5000, "\u0301combining \u0301after", "<|startoftext|>Hi<|endoftext|>", "\x1c\x1d y", "line.\n", "C:\\path_to\\x ~`^",
]
ANY = st.text(alphabet=" \n\t'.aEé1", max_size=12) | st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'.,aEé²<|>ß1")), st.characters(exclude_categories=["Cs"])), max_size=60)


def library(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(ANY)
def test_encoder_gives_the_librarys_ids(text):
    for path in (BYTE, WORD):
        encoder = encoding.encoder(path, 4)
        assert encoder.encode([text]) == encoder.whole([text])


@settings(max_examples=300, deadline=None)
@given(ANY)
def test_counter_gives_the_librarys_count(text):
    assert token_counts.counter(BYTE).count(text) == len(encoding.encoder(BYTE, 4).whole([text])[0]) // 4


def test_counts(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, BYTE).collect()}
    for i, t in enumerate(TEXTS):
        assert (got[i].n_bytes, got[i].n_tokens) == (len((t or "").encode()), len(library(BYTE, t))), t
    assert token_counts.count_tokens(docs.limit(0), BYTE).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4095, 4096, 4097, 12345])
def test_lengths(n):
    got = packing.lengths(n)
    assert sum(got) == n and all(k & k - 1 == 0 and k <= 4096 for k in got) and got == sorted(got, reverse=True)


def test_pack(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, bucket int").repartition(3)
    rows = packing.pack(docs, WORD, 2).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    assert all(r.offset == 0 and r.length == 1 << r.bucket == len(r.ids) // 4 for r in rows)
    assert [r.bucket for r in sorted(rows, key=lambda r: r.sequence_id)] == sorted(r.bucket for r in rows)
    for i, t in enumerate(TEXTS):
        pieces = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        want = library(WORD, t) + [2]
        assert np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist() == want
        assert [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist() and {r.doc_tokens for r in pieces} == {len(want)}
    assert packing.pack(docs.limit(0), WORD, 2).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    texts = [*TEXTS, "null id"]
    ids = [*range(40, 40 + len(TEXTS) - 1), 40, None]
    docs = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, shard string").repartition(3)
    folder = f"file://{tmp_path}/files"
    shards = token_files.write(docs, folder, BYTE, 0)
    rows = token_files.read_documents(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((i for i in ids if i is None), key=str) + sorted(i for i in ids if i is not None)
    assert [r.start for r in rows] == np.cumsum([0, *(len(r.ids) for r in rows)])[:-1].tolist()
    assert sorted(map(str, ((r.doc_id, list(r.ids)) for r in rows))) == sorted(map(str, ((i, library(BYTE, t) + [0]) for i, t in zip(ids, texts, strict=True))))
    assert sum(s["n_docs"] for s in shards) == len(texts)
    for r, s in zip(rows, token_files.read_summaries(spark, folder).orderBy("start").collect(), strict=True):
        assert (s.doc_id, s.n_tokens, s.ids_crc32) == (r.doc_id, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
    token_files.write(docs.limit(0), folder + "-none", BYTE, 0)
    assert token_files.read_summaries(spark, folder + "-none").count() == 0
