import corpus_pipeline
from granary.llm import quality, toxicity
from tests.conftest import SF
from tests.llm.test_packing import PATH, ids_of
from tests.llm.test_quality import plain
from tests.llm.test_secrets import expected
from tests.llm.test_simhash import plain_groups
from tokenizers import Tokenizer


def test_stages_against_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(corpus_pipeline.materialise(stage(spark, frames[-1], SF)))
    for df in frames[1:-1]:
        assert df.columns == docs.columns
    given, ruled, civil, single, masked = ({r.doc_id: r for r in f.collect()} for f in frames[:-1])
    assert len(ruled) == frames[1].count()

    verdicts = plain([(r.doc_id, r.source, r.text) for r in given.values()], quality.LINE_LIMIT, quality.LEFT)
    assert set(ruled) == {v[0] for v in verdicts if v[7]}

    field = toxicity.learn(frames[1], spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(civil) == {k for k, r in ruled.items() if field.judge(r.text or "")[0] < toxicity.FLAG}

    groups = plain_groups([(k, r.text) for k, r in civil.items()])
    assert set(single) == {g[2] for g in groups} and len(single) < len(civil)

    for k, r in single.items():
        text, at, want = r.text, 0, ""
        for s, _, e in expected(text)[1]:
            if s >= at:
                want += text[at:s] + "[SECRET]"
            at = max(at, e)
        assert masked[k].text == want + text[at:]

    tokenizer = Tokenizer.from_file(PATH)
    packed = frames[-1].collect()
    assert sum(p.length for p in packed) == sum(len(ids_of(tokenizer, r.text)) for r in masked.values())
    assert {p.doc_id for p in packed} == set(masked)
    again = corpus_pipeline.run(spark, SF).collect()
    assert sorted((p.doc_id, p.start, p.ids_crc32) for p in again) == sorted((p.doc_id, p.start, p.ids_crc32) for p in packed)
