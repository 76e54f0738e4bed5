import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from rulelens.llm import bpe
from rulelens.llm.queries import rank_file

ALPHABET = list("ab théü '\n\t12#\x1c\x85　​ sS漢字🙂")


@pytest.fixture(scope="module")
def ranks():
    return bpe.parse_ranks(rank_file())


@pytest.fixture(scope="module")
def expected(ranks):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: encoding.encode_ordinary(text or "")


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def texts(seed, n, longest=40):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("states, segment", [(600_000, 1 << 20), (50, 7)])
def test_transducer_is_bpe_with_full_and_short_tables(ranks, expected, monkeypatch, states, segment):
    monkeypatch.setattr(bpe, "SEGMENT_CHARS", segment)
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN, 10)
    encoder.machine.max_states = states
    decoder = bpe.Decoder(ranks)
    for text in [*texts(1, 2000), "the quick brown fox " * 200, "<|endoftext|>", "aaaaaaaaaaaaaaaaaaaaaaa", "x" * 300]:
        ids = encoder.encode(text)
        assert ids == packed(expected(text)), text
        assert decoder.decode(ids) == text


@pytest.mark.parametrize("cut", [True, False])
def test_texts_encoded_together(ranks, expected, cut):
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN, 50, cut)
    for seed, n in ((5, 400), (6, 1), (7, 2)):
        some = [*texts(seed, n), "one two", "two", "", " ", "two  one", "one two ", "a" * 50 + " b"][: 3 if n == 2 else None]
        got = encoder.encode_all(pa.array(some, pa.string())).to_pylist()
        assert got == [packed(expected(text)) for text in some]


def test_patterns_that_do_not_cut_at_spaces(spark, ranks):
    pattern = "[a-z ]+|[^a-z ]"
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    docs = spark.createDataFrame([(1, "of the people 12 by"), (2, "x")], "doc_id bigint, text string")
    got = bpe.encode(docs, rank_file(), pattern).collect()
    assert sorted(map(tuple, got)) == [(1, encoding.encode_ordinary("of the people 12 by")), (2, encoding.encode_ordinary("x"))]


def test_utf8_stream_holds_back_open_characters():
    rnd = random.Random(3)
    for text in texts(2, 300):
        data, stream, out = text.encode(), bpe.Utf8Stream(), ""
        while data:
            cut = rnd.randint(1, 5)
            out += stream.push(data[:cut])
            data = data[cut:]
        assert out + stream.finish() == text


def test_operator_on_odd_rows(spark, expected):
    rows = [(1, "Hello wörld", "x"), (1, "Hello wörld", "x"), (2, None, "y"), (None, "", None), (3, " a  b\n", "z"), (4, "long text " * 30_000, "q")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = bpe.encode_decode(docs, rank_file(), public_tokenizers.PATTERN, cut_at_spaces=True).collect()
    assert sorted((r[0] or 0, bytes(r[1]), r[2]) for r in got) == sorted((i or 0, packed(expected(t)), t or "") for i, t, _ in rows)
    lists = bpe.encode(docs.filter("doc_id < 4"), rank_file(), public_tokenizers.PATTERN).collect()
    assert sorted((r[0], r[1]) for r in lists) == sorted((i, expected(t)) for i, t, _ in rows if i and i < 4)
    assert bpe.encode_decode(docs.limit(0), rank_file(), public_tokenizers.PATTERN).count() == 0
