"""New chunks go to the tokenizers library many a line, and come back as the library has them alone."""

import numpy as np
import pytest

from barspark.llm.queries import tokenizer_file
from barspark.llm.token_files import LibraryEncoder, _tokenizer


class Counted:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def get_added_tokens_decoder(self):
        return self.tokenizer.get_added_tokens_decoder()

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def _encode(tokenizer, texts):
    raw = [t.encode() for t in texts]
    ends = np.cumsum([0, *map(len, raw)])
    return [x.tolist() for x in LibraryEncoder(tokenizer, 2).encode(np.frombuffer(b"".join(raw), np.uint8), ends)]


@pytest.mark.parametrize("odd", ["", "a\x00b\x7f \x1c", " \t \n\n x", "<|endoftext|>", "x y z", "it's 'Ś ​﻿", "\n", " "])
def test_lines_of_new_chunks_are_as_the_library_has_them(odd):
    t = _tokenizer(tokenizer_file("byte_bpe_50k.json"))
    texts = [" ".join(f"straße{i} мир{i} w{i}x," for i in range(50)) + odd, odd, odd + "end" + odd, "ü" + odd]
    assert _encode(t, texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_words_beyond_ascii_go_many_a_line():
    t = Counted(_tokenizer(tokenizer_file("byte_bpe_50k.json")))
    _encode(t, [" ".join(f"grüße{i}" for i in range(1000))])
    assert t.texts < 100
