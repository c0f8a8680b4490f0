"""The BPE path is that of merging by rank, and it is found with few arcs tried."""

import random

import pytest

from tarmac.llm import piece_fst as P
from tarmac.llm.queries import tokenizer


class Counting(dict):
    asked = 0

    def get(self, key, *default):
        self.asked += 1
        return super().get(key, *default)


@pytest.fixture(scope="module")
def fst():
    return P.PieceTransducer(tokenizer("piece_bpe_32k.model"))


def merged(fst, word):
    """Merging by rank, the leftmost of equal ranks first."""
    parts = list(word)
    while True:
        found = [(fst.score[x + y], -k) for k, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in fst.score]
        if not found:
            return parts
        k = -max(found)[1]
        parts[k:k + 2] = [parts[k] + parts[k + 1]]


def words():
    rng = random.Random(4)
    known = ["internationalization", "the", "xylophone", "aaaaaaaaaaaaaaaaaaaaaaa", "3.14159265", "中文字", "naïvé", "e\U0001f600f", "▁▁a"]
    return [P.META + w for w in known] + [P.META + "".join(rng.choices("etaoinshrdlu0123-", k=rng.randint(1, 30))) for _ in range(800)]


def test_path_is_that_of_merging(fst):
    for w in words():
        assert fst.shortest_path(w) == merged(fst, w), w


def test_few_arcs_are_tried(fst):
    fst._pairs = Counting()
    pieces = sum(len(fst.shortest_path(w)) for w in words())
    assert fst._pairs.asked <= 1.9 * pieces  # was 2.2


def test_a_word_without_path_is_told(fst, monkeypatch):
    monkeypatch.setattr(fst, "_pairs", {})
    monkeypatch.setattr(fst, "_follows", lambda left, right: False)
    with pytest.raises(ValueError):  # never ended
        fst.shortest_path("中\U0001f600中")
