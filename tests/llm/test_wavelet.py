import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helpers import MID, EDGE, edge_docs, empty_docs
from tarmac.llm import queries
from tarmac.llm.wavelet import Plane, WaveletMatrix, dump, encoder, load, token_digest


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 37), max_size=1300))
def test_matrix_answers_like_the_list(ids):
    m = WaveletMatrix.build(np.array(ids, np.uint16), 6)
    assert m.ids().tolist() == ids
    assert [m.access(i) for i in range(0, len(ids), 7)] == ids[::7]
    for s in (0, 5, 37, 63, 64, -1):
        places = [i for i, x in enumerate(ids) if x == s]
        assert m.count(s) == len(places) and m.occurrences(s) == places
        lo, hi = len(ids) // 4, len(ids) // 2
        assert m.count(s, lo, hi) == ids[lo:hi].count(s)


def test_plane_rank_and_select_over_many_blocks():
    bits = np.random.default_rng(1).random(5000) < 0.3
    p = Plane(np.packbits(bits), len(bits))
    assert all(p.rank1(i) == bits[:i].sum() for i in range(0, 5001, 97))
    for b in (0, 1):
        places = np.flatnonzero(bits == b)
        assert all(p.select(b, k) == places[k] for k in range(0, len(places), 53))


def test_shard_round_trip_and_damage():
    ids = np.array([3, 1, 2, 2], np.uint16)
    data = dump(ids, 16, pa.table({"id": [7], "n": [4]}))
    matrix, docs = load(data)
    assert matrix.ids().tolist() == ids.tolist() and docs.to_pydict() == {"id": [7], "n": [4]}
    for bad in (data[:-1], b"XXXX" + data[4:], data + b"\0"):
        with pytest.raises(Exception):
            load(bad)


def _want(rows):
    tok = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    out, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_digest_equals_the_tokenizer_on_all_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{MID}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op2_wavelet_tokens(spark, MID).collect())
    assert got == sorted(_want(rows))


def test_edge_cases(spark):
    got = token_digest(edge_docs(spark), queries.tokenizer("word_bpe_49k.json")).collect()
    key = lambda r: (r[1], str(r))
    assert sorted(map(tuple, got), key=key) == sorted(_want(EDGE), key=key)
    assert token_digest(empty_docs(spark), queries.tokenizer("word_bpe_49k.json")).collect() == []


def test_words_out_of_normal_form_and_special_tokens():
    path = queries.tokenizer("word_bpe_49k.json")
    texts = ["e\u0301te\u0301 x<|endoftext|>y", "ΣΑΣ İx", "don't WE'LL it's'", "a_b 12,5\u3000z\x1cq", "\u0301a \ufb01"]
    tok = Tokenizer.from_file(path)
    texts += ["".join(rng.choices("aB 'sré1\n.,<|endoftext|>-_\x7f\u3000", k=60)) for rng in [random.Random(3)] for _ in range(300)]
    ids, n = encoder(path)[0](pa.array(texts))
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want
