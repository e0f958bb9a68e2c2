import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from evidencelake.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    with open(PATH, "rb") as f:
        return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})


def test_equals_the_library_on_odd_texts(spark, odd, plain):
    out = bpe.encode(odd, PATH, public_tokenizers.PATTERN, decoded_col="decoded")
    assert set(odd.columns) < set(out.columns)
    rows = out.collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r["token_ids"] == plain.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_empty_table_and_replaced_column(spark, empty, odd):
    assert bpe.encode(empty, PATH, public_tokenizers.PATTERN).count() == 0
    out = bpe.encode(odd.withColumn("token_ids", F.lit("x")), PATH, public_tokenizers.PATTERN)
    assert out.schema["token_ids"].dataType.simpleString() == "array<int>"


@pytest.mark.parametrize("text", ["word " * 40000 + "'s don't 12ab", "a" + " " * 70000 + "b", "\n" * 60001, "é'll 9x" * 20000, "  " * 40000 + "x"])
def test_pieces_of_long_texts_give_the_same_ids(plain, text):
    with open(PATH, "rb") as f:
        codec = bpe.Codec(f.read(), public_tokenizers.PATTERN)
    assert codec.encode(text).tolist() == plain.encode_ordinary(text)
    assert codec.decode(codec.encode(text)) == text.encode()


def test_decodes_ids_that_are_not_whole_characters(plain):
    with open(PATH, "rb") as f:
        codec = bpe.Codec(f.read(), public_tokenizers.PATTERN)
    ids = codec.encode("漢")
    assert codec.decode(ids[:1]) == "漢".encode()[: len(codec.decode(ids[:1]))]


def test_a_run_of_space_that_the_library_cannot_match():
    with open(PATH, "rb") as f:
        codec = bpe.Codec(f.read(), public_tokenizers.PATTERN)
    text = "a" + " " * 2_000_000 + "b"
    assert codec.decode(codec.encode(text)) == text.encode()
