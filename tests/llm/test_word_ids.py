"""Words coded by the tokenizer's model alone: the ids of the whole tokenizer, without its calls."""

import random

import numpy as np
import public_tokenizers

from scoreweave.llm import packing

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def odd_words() -> list[str]:
    rnd = random.Random(4)
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 12))) for _ in range(3000)]
    plain = ["".join(rnd.choice("aeioustnrlABTéÈé") for _ in range(rnd.randrange(1, 20))) + rnd.choice(["", ".", ",", "?!"]) for _ in range(3000)]
    fixed = ["İstanbul,", "ſo", "ΣΑΣ", "中文.", "it's", "a1b2", "x́.", "ǅ", "ß", "ﬁn", "ͅa", "###", "ªº", "<|endoftext|>", "<|endoftext|>."]
    return [*words, *plain, *fixed, *(c for c in letters)]


def test_same_ids_as_the_tokenizer():
    coder, words = packing._WordIds(TOKENIZER), odd_words()
    known = coder.learn({w.encode() for w in words})
    assert coder.direct
    for w, e in zip(words, coder.coder.encode_batch(words, add_special_tokens=False)):
        assert np.frombuffer(known[w.encode()], "<u4").tolist() == e.ids, w


def test_latin_words_pass_by_the_normaliser():
    """Only what is not Latin letters with closing marks goes through the whole tokenizer."""
    coder, asked = packing._WordIds(TOKENIZER), []
    code = coder._code
    coder._code = lambda wanted: (asked.extend(w for w in wanted if w not in coder.ids), code(wanted))
    coder.learn({b"plain", b"Words,", "Èleé.".encode(), b"a1", b"it's"})
    assert sorted(asked) == [b",", b".", b"a1", b"it's"]
