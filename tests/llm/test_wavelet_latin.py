"""Words of Latin-1 letters get the library's ids without its normalising steps."""

import random

import pyarrow as pa
import tokenizers

from tarmac.llm import wavelet as W
from tarmac.llm.queries import tokenizer

LETTERS = [chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]


def texts():
    rng = random.Random(6)
    abc = LETTERS + list("abcdeinrstABCEIN0123.,'-!~") + ["é", "œ", "Σ", "²", "中"]
    made = [" ".join("".join(rng.choices(abc, k=rng.randint(1, 12))) for _ in range(30)) for _ in range(60)]
    return ["", " ".join(LETTERS), "L'ÉTÉ d'été l'œuvre ÀÉ's <|endoftext|>é", "É́a ×÷ª", *made]


def test_ids_are_the_librarys():
    path = tokenizer("word_bpe_49k.json")
    ids, n = W.encoder(path)[0](pa.array(texts()))
    found = [e.ids for e in tokenizers.Tokenizer.from_file(path).encode_batch(texts(), add_special_tokens=False)]
    assert n.tolist() == list(map(len, found))
    assert ids.tolist() == [i for x in found for i in x]


def test_latin_words_go_to_the_model(monkeypatch):
    asked = []

    class Seen:
        def __init__(self, tok):
            self.tok = tok

        @classmethod
        def from_file(cls, path):
            return cls(real.from_file(path))

        def __getattr__(self, name):
            return getattr(self.tok, name)

        def encode_batch_fast(self, words, **more):
            asked.extend(words)
            return self.tok.encode_batch_fast(words, **more)

    real = tokenizers.Tokenizer
    monkeypatch.setattr(tokenizers, "Tokenizer", Seen)
    monkeypatch.setattr(W, "_ENCODERS", {})
    W.encoder(tokenizer("word_bpe_49k.json"))[0](pa.array(["été Élan naïve, l'œuvre"]))
    assert asked == ["l'œuvre"]  # was all four
