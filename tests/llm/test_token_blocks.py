"""Token ids by blocks of texts."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lotlens.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [
    " ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "it's", "'ll", "'", "12", "!?", ",", "é", "à", "ü,", "你", "。", "々", "ª", "ʼ", "²", "٣", "ǅ",
    "\0", "\x1c", "\x85", " ", " ", "᠎", " ", "​", " ", "　", "́", "ﷺ", "\U0001f600", "\U0001d400", "<|endoftext|>", "word",
]


class Counted:
    def __init__(self, model):
        self.model, self.calls = model, 0

    def tokenize(self, word):
        self.calls += 1
        return self.model.tokenize(word)


def test_a_word_meets_the_model_once_though_no_more_words_are_kept():
    encoder = token_files.Encoder(PATH, kept=5)
    words = [f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxy'[i // 100]}" for i in range(500)]
    text = " ".join(words * 40)
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids + [0]
    encoder.model = Counted(encoder.model)
    assert encoder.encode(text) == np.array(want, "<u2").tobytes()
    assert encoder.model.calls <= 501  # the first word also stands without a space


@pytest.mark.parametrize("block", [1, 300, 2**23])
def test_blocks_equal_the_library(monkeypatch, block):
    monkeypatch.setattr(token_files, "BLOCK", block)
    encoder, draw = token_files.Encoder(PATH, kept=50), random.Random(8)
    texts = ["".join(draw.choices(PARTS, k=draw.randrange(14))) for _ in range(4000)]
    want = [e.ids + [0] for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for some in (pa.array(texts), pa.array(["cut off", *texts, "cut off"]).slice(1, len(texts))):
        got = [*encoder.encode_all(some)]
        assert b"".join(bytes(ids) for ids, _ in got) == np.concatenate(want).astype("<u2").tobytes()
        assert [int(n) for _, counts in got for n in counts] == [*map(len, want)]
    assert [*encoder.encode_all(pa.array([], pa.string()))] == []
    assert [(bytes(i), n.tolist()) for i, n in encoder.encode_all(pa.array([""]))] == [(encoder.end, [1])]
    encoder.by_word = False
    assert b"".join(bytes(ids) for ids, _ in encoder.encode_all(pa.array(texts))) == np.concatenate(want).astype("<u2").tobytes()
