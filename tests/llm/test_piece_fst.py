import itertools
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from helpers import EDGE, SMALL, edge_docs, empty_docs
from tarmac.llm import queries
from tarmac.llm.piece_fst import META, PieceTransducer, encode, encode_texts

PATH = queries.tokenizer("piece_bpe_32k.model")


def test_every_document_encodes_as_the_library_does(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    want = dict(zip(texts, sentencepiece.SentencePieceProcessor(model_file=PATH).encode(list(texts.values()))))
    rows = encode(spark.read.parquet(f"{SMALL}/documents.parquet"), PATH).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == want[r.doc_id] and r.n_pieces == len(r.ids) and r.round_trip
    assert len(queries.op8_piece_fst(spark, SMALL).collect()) == len(texts)


def test_odd_texts():
    rng = random.Random(4)
    odd = [t or "" for _, t in EDGE[:7] + EDGE[9:]] + [" ", "  a   b ", "x\n\ny\tz", "       " + "the" * 20, "a" * 300, "é Ω ﬁ",
           *("".join(rng.choices("ab the  \n.,é日👍▁<0x0A>", k=40)) for _ in range(200))]
    want = sentencepiece.SentencePieceProcessor(model_file=PATH).encode(odd)
    assert [x.tolist() for x in encode_texts(PATH, odd)] == want
    fst = PieceTransducer(PATH)
    assert [fst.decode(np.array(x, int)).decode() for x in want] == [t.replace(META, " ") for t in odd]


def test_edge_cases(spark):
    rows = encode(edge_docs(spark), PATH).collect()
    assert len(rows) == len(EDGE) and all(r.round_trip for r in rows)
    assert all((r.n_pieces == 0) == (r.doc_id in (1, 2)) for r in rows)
    assert encode(empty_docs(spark), PATH).collect() == []


def _unigram(tmp_path, pieces):
    m = sentencepiece_model_pb2.ModelProto()
    m.trainer_spec.model_type = 1
    m.normalizer_spec.remove_extra_whitespaces = False
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3)] + [(p, s, 1) for p, s in pieces]:
        m.pieces.add(piece=piece, score=score, type=kind)
    (tmp_path / "m").write_bytes(m.SerializeToString())
    return PieceTransducer(str(tmp_path / "m"))


def test_unigram_path_is_the_cheapest_segmentation(tmp_path):
    rng = random.Random(1)
    pieces = [(p, -rng.uniform(1, 9)) for n in (1, 2, 3) for p in map("".join, itertools.product("abc", repeat=n)) if n == 1 or rng.random() < 0.4]
    fst = _unigram(tmp_path, pieces)
    score = dict(pieces)
    for _ in range(60):
        word = "".join(rng.choices("abcd", k=rng.randint(1, 9)))
        best = {0: 0.0}
        for cuts in itertools.product((0, 1), repeat=len(word) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
            parts = [word[a:b] for a, b in zip(at, at[1:])]
            if all(p in score or len(p) == 1 for p in parts):
                best[0] = max(best[0] if best[0] else -1e9, sum(score.get(p, fst.unknown) for p in parts))
        assert abs(sum(score.get(p, fst.unknown) for p in fst.shortest_path(word)) - best[0]) < 1e-9


def test_unsupported_models_are_refused(tmp_path):
    with pytest.raises(ValueError):
        _unigram(tmp_path, [(f"a{META}b", -1.0)])


def test_the_query_gives_the_ids(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.op8_piece_fst(spark, SMALL).collect()  # gave their number and checksum only
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert {r.doc_id: r.ids for r in rows} == dict(zip(texts, library.encode(list(texts.values()))))
    assert all(r.n_pieces == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4")) for r in rows)
