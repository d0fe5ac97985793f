import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from rillflow.llm import bpe, token_count, token_file
from rillflow.llm.queries import BYTE_BPE, PIECES, WORD_BPE, coded_digests
from tokenizers import Tokenizer, models, pre_tokenizers

from tests.llm.helpers import awkward, awkward_rows, empty, plain_rows

ODD = st.text(st.sampled_from("abcAB 's't  \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　.,!09é漢😀ΣςIİ́<|endoftext|>▁"), max_size=40)


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTE_BPE())


@pytest.fixture(scope="module")
def lexicon(tmp_path_factory):
    words = [" the", "the", "there", " other", "a", "é", "tion", " nation"]
    own = bpe.ByteBpe(BYTE_BPE())
    path = str(tmp_path_factory.mktemp("lexicon") / "words.dawg")
    bpe.compile_lexicon({w.encode(): own.merge(w.encode()) for w in words}, path)
    return words, own, bpe.Lexicon(path)


def test_lexicon_finds_its_words_and_no_others(lexicon):
    words, own, found = lexicon
    for w in words:
        assert found.find(w.encode()) == np.array(own.merge(w.encode()), "<u4").tobytes()
    for w in ("", "th", "thee", " tion", "nation", "x"):
        assert found.find(w.encode()) is None


def test_lexicon_shares_suffixes(tmp_path):
    stems = [f"{a}{b}" for a in "abcdefgh" for b in "xyz"]
    bpe.compile_lexicon({f"{s}ation{e}".encode(): [i] for i, (s, e) in enumerate((s, e) for s in stems for e in ("", "s"))}, str(tmp_path / "a"))
    lex = bpe.Lexicon(str(tmp_path / "a"))
    assert len(lex.first) - 1 < 12 and lex.find(b"bxations") is not None
    bpe.compile_lexicon({}, str(tmp_path / "b"))
    assert bpe.Lexicon(str(tmp_path / "b")).find(b"a") is None


@settings(max_examples=400, deadline=None)
@given(ODD)
def test_encoding_equals_the_library(byte_library, lexicon, text):
    _, own, found = lexicon
    ids = np.frombuffer(bpe.Encoder(own, found).encode(text), "<u4").tolist()
    assert ids == byte_library.encode(text, add_special_tokens=False).ids
    assert own.decode(ids) == byte_library.decode(ids, skip_special_tokens=False)


def test_kept_chunks_take_few_bytes_each(lexicon):
    encoder = bpe.Encoder(*lexicon[1:])
    encoder.encode(" warm")
    texts = pa.array([" ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(17_000))])
    tracemalloc.start()
    try:
        arrow = pa.total_allocated_bytes()
        encoder.encode_all(texts)
        grown = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    finally:
        tracemalloc.stop()
    assert grown < 80 * 17_000  # 180 as Python strings in a dict


def test_kept_chunks_are_bounded_in_bytes(byte_library, lexicon, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 3_000)
    encoder = bpe.Encoder(*lexicon[1:])
    for k in range(6):
        texts = [f" the a{k}b, x{j}  there <|endoftext|> {'long' * (50 * j)} nation" for j in range(6)] + ["", "the the"]
        found = [x.tolist() for x in encoder.encode_all(pa.array(texts))]
        assert found == [byte_library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(encoder.memo.texts) and encoder.memo.held <= 3_000


def test_round_trip_of_a_table(spark, byte_library):
    import hashlib

    want = []
    for doc_id, text, *_ in awkward_rows():
        ids = byte_library.encode(text or "", add_special_tokens=False).ids
        back = byte_library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    for most in (0, 20, bpe.LEXICON):
        assert plain_rows(coded_digests(bpe.encode_and_decode(awkward(spark), BYTE_BPE(), most))) == sorted(want, key=repr)
    assert bpe.encode_and_decode(empty(spark), BYTE_BPE()).count() == 0


@pytest.fixture(scope="module")
def unigram():
    vocab = token_count.unigram_vocabulary(PIECES())
    library = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    return token_count.Counter(vocab), library


@settings(max_examples=400, deadline=None)
@given(ODD)
def test_count_equals_the_library(unigram, text):
    counter, library = unigram
    assert counter(text)[0] == len(library.encode(text).ids)


def test_counts_of_a_table(spark, unigram):
    _, library = unigram
    out = token_count.count_tokens(awkward(spark), PIECES()).select("doc_id", "n_tokens")
    assert plain_rows(out) == sorted(((r[0], len(library.encode(r[1] or "").ids)) for r in awkward_rows()), key=repr)
    assert token_count.count_tokens(empty(spark), PIECES()).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("a b ab ba bab abab c".split()), min_size=1, max_size=12, unique=True), st.data())
def test_ties_go_as_in_the_library(pieces, data):
    vocab = [("<unk>", -9.0), ("▁", -2.0)] + [(p, -float(data.draw(st.integers(1, 3)))) for p in pieces]
    library = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=False))
    text = data.draw(st.text("abcd", max_size=14))
    assert token_count.Counter(vocab, byte_fallback=False).viterbi(text)[0] == len(library.encode(text).ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 200), min_size=1, max_size=300))
def test_blocks_round_trip(ids):
    block = np.array(ids, np.uint32)
    assert (token_file.unpack_block(token_file.pack_block(block)) == block).all()


def test_outliers_do_not_widen_a_block():
    block = np.full(1024, 7, np.uint32)
    block[::40] = 2**31
    assert len(token_file.pack_block(block)) < 1024


def test_token_files_of_a_table(spark):
    library = Tokenizer.from_file(WORD_BPE())
    manifest = token_file.write_token_files(awkward(spark), WORD_BPE())
    got = [(r["doc_id"], r["start"], r["ids"]) for r in token_file.read_token_files(spark, manifest).collect()]
    got.sort(key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in awkward_rows()), key=lambda i: (i is not None, i or 0))
    want = sorted(((r[0], zlib.crc32(np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for r in awkward_rows()), key=repr)
    assert sorted(((d, zlib.crc32(bytes(ids))) for d, _, ids in got), key=repr) == want
    place = 0
    for _, start, ids in got:
        assert start == place
        place += len(ids) // 4
    nothing = token_file.write_token_files(empty(spark), WORD_BPE())
    assert nothing.count() == 0 and token_file.read_token_files(spark, nothing).count() == 0


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_chunked_library_encoding_equals_whole(text):
    own = token_file._library(WORD_BPE())
    assert own(text).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_vocabularies_are_given_by_path():
    assert BYTE_BPE() == public_tokenizers.path("byte_bpe_50k.json")
