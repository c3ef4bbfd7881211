import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from partwise.llm import tokens
from partwise.llm.common import read
from partwise.llm.queries import op4_huffman_tokens

from helpers import awkward, empty

SF = "/root/testdata/sf0.001"


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


def expected(rows):
    tok, out, start = library(), [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=repr)


def test_query_against_library(spark):
    rows = [(r["doc_id"], r["text"]) for r in read(spark, SF, "documents").collect()]
    assert sorted(map(tuple, op4_huffman_tokens(spark, SF).collect()), key=repr) == expected(rows)


def test_awkward_rows_in_several_files(spark):
    docs = awkward(spark, [(11, "It's <|endoftext|> J̌ ǰ ½ x's y'all", "en", "a"), (12, "Ünïcödé ÀÉ, ÿ; a_b", "en", "a")])
    want = expected([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(map(tuple, tokens.through_files(docs, range_bytes=200).collect()), key=repr) == want


def test_any_other_tokenizer_file_encodes_whole_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["two  blanks\n and a line", "<|endoftext|>", " x", "plain words"]
    tok = Tokenizer.from_file(path)
    got = [np.frombuffer(x, dtype="<u2").tolist() for x in tokens.encode_texts(texts, path)]
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert tokens._encoder(path).whole and not tokens._encoder(tokens.default_tokenizer()).whole


def test_small_parts_and_files(spark, monkeypatch):
    monkeypatch.setattr(tokens, "PART_BYTES", 64)
    monkeypatch.setattr(tokens, "PARTS", 2)
    docs = awkward(spark, [(100 + i, f"word{i} and more {i}", "en", "a") for i in range(60)])
    want = expected([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(map(tuple, tokens.through_files(docs, range_bytes=10_000).collect()), key=repr) == want


def test_empty(spark):
    assert tokens.through_files(empty(spark)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=40), max_size=5))
def test_words_alone_are_encoded_as_in_the_text(texts):
    tok = library_cached()
    got = [np.frombuffer(x, dtype="<u2").tolist() for x in tokens.encode_texts(texts, tokens.default_tokenizer())]
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def library_cached(memory=[]):  # noqa: B006
    if not memory:
        memory.append(library())
    return memory[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), max_size=600), min_size=1, max_size=6))
def test_round_trip(docs):
    ids = np.array([x for d in docs for x in d], dtype=np.uint16)
    starts = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)
    counts = np.bincount(ids, minlength=65536)
    lengths = tokens.code_lengths(counts)
    assert sum(2.0 ** -int(n) for n in lengths if n) <= 1
    data, at, within = tokens.encode_ids(ids, starts, tokens.canonical_codes(lengths), lengths)
    checks = np.concatenate([within[a : b : tokens.STEP] for a, b in zip(starts[:-1], starts[1:])])
    assert tokens.decode_ids(data, at[:-1], np.diff(starts), checks, tokens.decode_table(lengths)).tolist() == ids.tolist()


def test_lengths_are_limited_and_optimal():
    fib = [1, 1]
    while len(fib) < 30:
        fib.append(fib[-1] + fib[-2])
    lengths = tokens.code_lengths(np.array(fib))
    assert lengths.max() == 16 and sum(2.0 ** -int(n) for n in lengths) == pytest.approx(1)
    assert tokens.code_lengths(np.array([1, 1, 2, 4])).tolist() == [3, 3, 2, 1]
