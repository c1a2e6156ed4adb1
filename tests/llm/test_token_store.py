"""Token-id files: exact round trips, access to parts, and the ids the library gives."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from fixture_docs import frame, hard_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import grammar, token_store
from millrace.session import new_folder

PATH = public_tokenizers.path("word_bpe_49k.json")
HOSTILE = [
    "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "<|endof text|>", "I'll DON'T 's'T", "ΣΑΣ ΑΣ",
    "é ́x ̈", "a b c\u0085d", "x\v\fy\r\nz", "ﬁ Å Å", "1234 ٣٤", "\0\1 \x1c\x1f",
    "日本語 テキスト", "👩‍👩‍👧 é" * 3, "İI ı", " ", "",
]


LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    return LIBRARY


def _ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("piece", [1, 1 << 20])
def test_words_together_give_the_ids_of_the_text(library, monkeypatch, piece):
    monkeypatch.setattr(token_store, "PIECE", piece)
    monkeypatch.setattr(token_store, "KNOWN_WORDS", 50)
    encode = token_store.Encoder(PATH)
    texts = [*HOSTILE, " ".join(HOSTILE), "".join(HOSTILE), *[t or "" for _, t, _ in hard_rows()]]
    for some in (texts, texts[::-1]):
        ids, ends = encode.ids([t.encode() for t in some])
        assert len(ids) == ends[-1]
        for text, a, b in zip(some, [0, *ends], ends):
            assert ids[a:b].tolist() == _ids(library, text)


MARKS = [".", ",", ";:", "!", "?", "...", "-", "'", "'S", "<", "|>", "<|endoftext|>", "é", "\u0301", "9",
         " ", "\n", "\u2028", "\u00a0", "Word", "a", "\u01c5", "\u0130", "ß", "中"]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(MARKS), max_size=20).map("".join)))
def test_any_text(text):
    ids, _ = token_store.encoder(PATH, True).ids([text.encode()])
    assert ids.tolist() == _ids(LIBRARY, text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=400), st.sampled_from([4, 1 << 20]), st.data())
def test_grammar_round_trip(ids, base, data):
    found = grammar.compress(np.array(ids, np.uint32), base)
    assert found.ids().tolist() == found.expand(found.sequence).tolist() == ids
    start = data.draw(st.integers(0, len(ids)))
    stop = data.draw(st.integers(start, len(ids)))
    assert found.part(start, stop).tolist() == ids[start:stop]


def test_grammar_is_shorter_and_keeps_to_its_rules():
    rng = np.random.default_rng(1)
    phrase = rng.integers(0, 49408, 500, dtype=np.uint32)
    ids = np.concatenate([phrase, rng.integers(0, 49408, 300, dtype=np.uint32)] * 20)
    found = grammar.compress(ids, 49408)
    assert found.sequence.dtype == np.uint16 and len(found.sequence) < len(ids) / 8
    rules = np.arange(len(found.left)) + found.base
    assert (found.left < rules).all() and (found.right < rules).all()
    few = grammar.compress(ids, 49408, rules=7)
    assert len(few.left) <= 7 and (few.ids() == ids).all()


def test_one_document_of_a_shard():
    documents = [[5, 6, 5, 6, 1], [1], [5, 6, 5, 6, 5, 6, 1]]
    ids = np.array(sum(documents, []), np.uint32)
    content = token_store.Shard.of([3, None, 3], ids, [5, 6, 13], 100).to_bytes()
    shard = token_store.Shard.from_bytes(content)
    assert shard.doc_ids == [3, None, 3]
    assert [shard.document(i).tolist() for i in range(3)] == documents
    for wrong in (b"XXXX" + content[4:], content[:-1] + bytes([content[-1] ^ 1])):
        with pytest.raises(ValueError):
            token_store.Shard.from_bytes(wrong)


def _stored(spark, rows, **options):
    path = new_folder(spark, "ids")
    token_store.write_ids(frame(spark, rows), path, PATH, **options)
    return token_store.digests(token_store.read_ids(spark, path)), path


@pytest.mark.parametrize("options", [{}, {"shard_ids": 500}, {"by_word": False, "shard_ids": 1}])
def test_hard_documents(spark, library, options):
    rows = hard_rows() + [(300 + i, t, "s") for i, t in enumerate(HOSTILE)]
    found, path = _stored(spark, rows, **options)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    found = [tuple(r) for r in found.orderBy("start").collect()]
    at, want = 0, []
    for doc_id, text, _ in rows:
        ids = np.array([*_ids(library, text), 1], "<u4")
        want.append((doc_id, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(((d, n, c) for d, _, n, c in found), key=str) == sorted(want, key=str)
    assert [r[0] or -1 for r in found] == sorted(r[0] or -1 for r in found)
    for _, start, n, _ in found:
        assert start == at
        at += n
    if options:
        assert spark.read.parquet(path).count() > 5


def test_empty_table(spark):
    assert _stored(spark, [])[0].collect() == []
