import pytest

import corpus_pipeline
from helpers import EDGE, MID, empty_docs
from tarmac.llm import bm25_leaks, jaccard_tiles, pii_crf, pu_toxicity
from tarmac.llm.common import table, written
from tarmac.llm.piece_fst import PieceTransducer
from test_jaccard import _brute


def test_every_stage_against_its_input(spark):
    sf = MID
    docs = table(spark, sf, "documents")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "pieces"]
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(written(stage(spark, steps[-1], sf), name))
    assert all(s.columns == names for s in steps[:-1])
    texts = [{r.doc_id: r.text for r in s.collect()} for s in steps[:-1]]
    model = pu_toxicity.train(docs, table(spark, sf, "labels"))
    assert texts[1].keys() == {i for i, t in texts[0].items() if model.score(t or "") < 0.5}
    assert texts[2].keys() == {i for i, _, c in _brute(list(texts[1].items())) if i == c}
    leaks = {r.doc_id for r in bm25_leaks.find_leaks(steps[2], table(spark, sf, "benchmark")).collect()}
    assert leaks and texts[3].keys() == texts[2].keys() - leaks
    assert texts[4].keys() == texts[3].keys()
    crf = pii_crf.train(steps[3])
    for i, t in texts[3].items():
        _, spans = pii_crf.find_spans([t], crf)[0]
        assert (texts[4][i] == t) == (not spans) and not any(t[s:e] in texts[4][i] for k, s, e in spans if k != "ip")
    import public_tokenizers

    fst = PieceTransducer(str(public_tokenizers.path("piece_bpe_32k.model")))
    last = {r.doc_id: r for r in steps[5].collect()}
    assert last.keys() == texts[4].keys()
    assert all(r.round_trip and fst.decode(r.ids).decode() == texts[4][i] for i, r in last.items())
    assert corpus_pipeline.run(spark, sf).count() == len(last)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = [(i, t, None, "s", None if t is None else len(t), 7) for i, t in EDGE]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    got = stage(spark, docs, MID).collect()
    assert len(got) == (len(EDGE) - (2 if name == "near_duplicates" else 0))
    assert stage(spark, empty_docs(spark), MID).collect() == []
    assert jaccard_tiles.BLOCK > 0
