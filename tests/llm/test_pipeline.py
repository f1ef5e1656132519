"""The pipeline's stages against plain versions, each on its own input."""

import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from quantgrid.core import store
from quantgrid.llm import labelled, quality, queries, toxicity
from test_jaccard import brute
from test_secrets import plain

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = queries.table(spark, SF, "documents")
    labels = queries.table(spark, SF, "labels")
    schema = docs.schema.simpleString()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "quality classifier", "n-gram Jaccard join", "secret scans", "best-fit packing"]
    at = {None: {r.doc_id: r for r in docs.collect()}}
    rows = at[None]

    model = toxicity.train(docs, labels)
    terms = labelled.TermIds(toxicity.BUCKETS, toxicity.STARTS)
    kept = store(stages["toxicity"](spark, docs, SF))
    assert kept.schema.simpleString() == schema
    clean = {r.doc_id: r for r in kept.collect()}
    assert clean == {i: r for i, r in rows.items() if model.margin(terms.of_text(r.text)) < 0} and len(clean) < len(rows)

    ranker = quality.train(kept, labels)
    scores = ranker.scores(np.array([quality.statistics(r.text) for r in clean.values()]))
    docs = store(stages["quality classifier"](spark, kept, SF))
    assert docs.schema.simpleString() == schema
    good = {r.doc_id: r for r in docs.collect()}
    assert good == {r.doc_id: r for r, s in zip(clean.values(), scores) if s >= 0.3} and 0.5 * len(clean) < len(good) < len(clean)

    single = store(stages["n-gram Jaccard join"](spark, docs, SF))
    assert single.schema.simpleString() == schema
    left = {r.doc_id: r for r in single.collect()}
    firsts = {c for _, _, c, _ in brute([(i, r.text) for i, r in good.items()])}
    assert left == {i: good[i] for i in firsts} and len(left) < len(good)

    masked = store(stages["secret scans"](spark, single, SF))
    assert masked.schema.simpleString() == schema
    done = {r.doc_id: r for r in masked.collect()}
    assert done.keys() == left.keys()
    changed = {i for i in done if done[i] != left[i]}
    assert changed == {i for i, r in left.items() if plain(r.text)[4]} and changed
    assert all("[SECRET]" in done[i].text and len(done[i].text) == done[i].n_chars for i in changed)

    from tokenizers import Tokenizer
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = stages["best-fit packing"](spark, masked, SF).collect()
    want = []
    for i, r in done.items():
        ids = np.array(words.encode(r.text, add_special_tokens=False).ids + [1], "<u4")
        want += [(i, k // 4096, k, len(ids[k:k + 4096]), zlib.crc32(ids[k:k + 4096].tobytes())) for k in range(0, len(ids), 4096)]
    assert sorted(tuple(p)[:5] for p in pieces) == sorted(want)
    room = {}
    for p in pieces:
        room.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for v in room.values():
        assert sum(n for _, n in v) <= 4096
        assert [o for o, _ in sorted(v)] == np.concatenate([[0], np.cumsum([n for _, n in sorted(v)])[:-1]]).tolist()
    assert len(room) <= -(-sum(p.length for p in pieces) // 4096) * 1.02 + 1

    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted(tuple(p)[:5] for p in whole) == sorted(want)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, name, stage):
    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (2, "", None, "s", 0), (None, "some words here", "en", "s", 3), (3, "y " * 60_000, "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = stage(spark, docs, "/root/testdata/sf0.001")
    assert name == "best-fit packing" or out.schema.simpleString() == docs.schema.simpleString()
    assert out.count() <= 40
    assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
