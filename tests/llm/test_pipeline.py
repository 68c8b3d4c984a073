import corpus_pipeline as C
import pytest

from genolith.llm import decontamination, neardup, quality

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('stages')}"
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = [docs]
    for k, (_, f) in enumerate(C.STAGES):
        f(spark, docs, FOLDER).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        kept.append(docs)
    return kept


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_each_stage_on_its_own_input(spark, stages):
    docs, good, single, clean, safe, packed = stages
    for s in (good, single, clean, safe):
        assert s.columns == docs.columns
    assert ids(good) == ids(quality.assess(docs).where("kept"))
    assert ids(single) == ids(neardup.labelled(good).where("kept"))
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    assert ids(clean) == ids(decontamination.judged(decontamination.scan(single, bench)).where("not contaminated"))
    assert ids(safe) == ids(clean) and sorted({r.doc_id for r in packed.collect()}) == ids(safe)
    before = {r.doc_id: r.text for r in single.collect()}
    untouched = {r.doc_id for r in decontamination.scan(single, bench).where("size(hit_starts) = 0").collect()}
    assert all(r.text == before[r.doc_id] for r in clean.collect() if r.doc_id in untouched)
    assert all(r.n_chars == len(r.text) for r in safe.collect())


def test_run_gives_the_last_stage(spark, stages):
    pick = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert pick(C.run(spark, FOLDER)) == pick(stages[-1])


def test_odd_rows(spark, odd, tmp_path):
    docs = odd
    for _, f in C.STAGES:
        docs = f(spark, docs, FOLDER)
    docs.count()
