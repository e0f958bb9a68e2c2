import random

import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from evidencelake.llm import token_counts

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model")
ODD = [
    None, "", " ", "  a", "a ", "a  b", "a\nb \n c", "it's <|endoftext|> x<|endoftext|>y", "<s> a </s> b", "<|startoftext|> a", "été œuvre  x", "x　  y", "x  y", "漢字 漢字  !",
    "ΣΑΣ ΣΑΣ x", "á ̈b", "\u0085 \u0085  a", "Привет  мир \t и", "\x1c a\x1c  b", "a ​ b", "“ a ” —  b", "😀 😀  😀", " ▁ a ▁b", "ＡＢ Ｃ １", "a\r\n\r\nb", "don't  we'll 've",
]


def plain(name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        core = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(core.encode(t))
    core = Tokenizer.from_file(path)
    return lambda t: len(core.encode(t, add_special_tokens=False).ids)


@pytest.fixture(scope="module", params=FILES)
def both(request):
    with open(public_tokenizers.path(request.param), "rb") as f:
        return token_counts.Counter(f.read(), request.param), plain(request.param)


def test_pieces_are_used(both):
    assert both[0].cuts


def test_equals_the_library(both):
    counter, own = both
    random.seed(5)
    chars = "aZ9.,'  \n\t 　é漢<|>s_- ▁"
    texts = ODD + ["".join(random.choice(chars) for _ in range(random.randint(1, 60))) for _ in range(1500)]
    assert counter.count(pa.array(texts)).tolist() == [own(t or "") for t in texts]


@pytest.mark.parametrize("text", ["word " * 40000, "a" + " " * 300000 + "b", "\n" * 60001, "x" * 200000, "é'll 9x" * 20000, "  " * 40000 + "x"])
def test_long_texts(both, text):
    counter, own = both
    assert counter.count(pa.array([text])).tolist() == [own(text)]


def test_what_is_remembered_changes_nothing(both, monkeypatch):
    counter, own = both
    texts = ["a b c d e", "e d x y", "", "a b zz", "q" * 50, "a b c d e"]
    for most in (16 << 20, 60, 0):
        monkeypatch.setattr(token_counts, "KNOWN_BYTES", most)
        for k in range(len(texts)):
            assert counter.count(pa.array(texts[k:])).tolist() == [own(t) for t in texts[k:]]


def test_a_vocabulary_whose_tokens_hold_spaces_is_not_cut():
    core = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    core.add_tokens(["so far"])
    counter = token_counts.Counter(core.to_str().encode(), "own.json")
    assert not counter.cuts
    assert counter.count(pa.array(["so far", None])).tolist() == [1, 0]


def test_truncation_and_padding_of_the_file_are_not_used():
    core = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    core.enable_truncation(2)
    core.enable_padding(length=9)
    assert token_counts.Counter(core.to_str().encode(), "own.json").count(pa.array(["a b c d", ""])).tolist() == [4, 0]


def test_rows_and_columns(odd, empty):
    path = public_tokenizers.path(FILES[0])
    own = plain(FILES[0])
    out = token_counts.count_tokens(odd, path, tokens_col="tokens")
    assert out.columns == [*(c for c in odd.columns if c != "tokens"), "n_bytes", "tokens"]
    rows = out.collect()
    assert len(rows) == odd.count()
    assert all((r["n_bytes"], r["tokens"]) == (len((r["text"] or "").encode()), own(r["text"] or "")) for r in rows)
    assert token_counts.count_tokens(empty, path).count() == 0


def test_other_files_are_refused(spark, odd, tmp_path):
    with pytest.raises(ValueError):
        token_counts.Counter(b"", "x.tiktoken")
