from collections import defaultdict

import corpus_pipeline
from granary.llm import quality_rules, secret_scan
from granary.llm.common import written
from granary.llm.registry import tokenizer_path
from tests.llm import fixtures
from tests.llm.test_bin_packing import check
from tests.llm.test_jaccard_join import brute
from tests.llm.test_source_mixing import size


def test_each_stage_against_its_own_input(spark, tmp_path):
    given = [f"{t} token = Abc123defghi" if t and i % 9 == 0 else t for i, t in enumerate(fixtures.texts() + fixtures.AWKWARD)]
    docs = fixtures.frame(spark, given)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "jaccard_join", "secret_scan", "source_mixing", "bin_packing"]
    step = lambda name, df: written(stages[name](spark, df, str(tmp_path)))
    keyed = lambda df: sorted(map(repr, fixtures.local(df)))

    good = step("quality_rules", docs)
    kept = {r["doc_id"] for r in fixtures.local(quality_rules.quality_rules(docs, labels)) if r["kept"]}
    assert keyed(good) == keyed(docs.filter(docs.doc_id.isin([k for k in kept if k is not None]) | (docs.doc_id.isNull() if None in kept else docs.doc_id.isin(-1))))

    alone = step("jaccard_join", good)
    components = brute([(r["doc_id"], r["text"]) for r in fixtures.local(good)])
    assert sorted((r["doc_id"] for r in fixtures.local(alone)), key=repr) == sorted({c for _, _, c in components}, key=repr)

    clean = step("secret_scan", alone)
    assert clean.count() == alone.count()
    assert all(not r["spans"] for r in fixtures.local(secret_scan.scan(clean)))

    mixed = step("source_mixing", clean)
    assert mixed.columns == docs.columns
    words = lambda df: sum(size(r["text"]) for r in fixtures.local(df))
    assert abs(words(mixed) - 1.5 * words(clean)) <= 4
    most = defaultdict(int)
    for r in fixtures.local(mixed):
        most[r["doc_id"]] += size(r["text"])
    for r in fixtures.local(clean):
        assert most[r["doc_id"]] <= 2 * size(r["text"])

    packed = step("bin_packing", mixed)
    used, least = check(fixtures.local(packed), fixtures.local(mixed), 4096)
    assert used <= 1.05 * least + 2

    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in fixtures.local(whole)) == sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in fixtures.local(packed))


def test_empty_tables(spark, tmp_path):
    fixtures.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
