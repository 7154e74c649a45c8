"""The encoder that op3, op4 and the pipeline share: ids of the library, and how seldom its model is asked."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ratescale.llm.common import TextEncoder

FILES = [public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")]
TEXTS = [
    "", " ", "\n", "a\nb", "a \nb", "a\n\nb", "a\n b", "\na", "a\n", " a.\nB, C", "Café Écoleß ªµº", "café\ńx", "Kelvin İx", "it's\n's", "x1 22\n3",
    "<|endoftext|>\na", "a <|endoftext|> B", "a\r\nb\tc\x0bd\x1ce", "日本\n語", "word. word, word; word", "a  b c　d",
]


@pytest.mark.parametrize("file", FILES)
def test_ids_are_the_librarys(file):
    library, encoder = Tokenizer.from_file(file), TextEncoder(file)
    for texts in (TEXTS, TEXTS[::-1]):  # learnt, and remembered
        for start, ids, lens in encoder.encode(texts):
            for text, own in zip(texts[start:], np.split(ids, np.cumsum(lens)[:-1])):
                assert own.tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("file", FILES)
def test_small_caches_give_the_same_ids(file):
    want, got = ([ids.tolist() for text in TEXTS * 3 for _, ids, _ in e.encode([text])] for e in (TextEncoder(file), TextEncoder(file, 600)))
    assert got == want


def test_the_model_sees_a_word_once():
    encoder, asked = TextEncoder(FILES[0]), []

    class Asked:
        def tokenize(self, text, model=encoder.model):
            asked.append(text)
            return model.tokenize(text)

    encoder.model = Asked()
    list(encoder.encode(["word, Word; word\nword. WORD!", "word? (word) word.\nword"]))
    assert asked.count("word") <= 2  # by itself, and in "(word)"
    assert not any("\n" in t for t in asked) and len(asked) == len(set(asked)) + asked.count("word") - 1
