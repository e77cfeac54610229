from collections import Counter

import corpus_pipeline


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).persist()
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] == sizes[4] > 0
    packed = corpus_pipeline.pack_tokens(spark, docs, sf).collect()
    rows = corpus_pipeline.run(spark, sf).collect()
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])
    assert Counter(map(key, rows)) == Counter(map(key, packed))
    assert rows[0]["doc_tokens"] > 0


def test_stages_on_odd_and_empty_tables(spark, sf, odd, none):
    """Null, empty, odd and repeated texts, clashing columns, and no rows at all: every stage ends, with the columns that it got."""
    for docs in (odd, none):
        columns, left = docs.columns, docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf).persist()
            assert docs.columns == columns, name
            assert docs.count() <= left, name
            left = docs.count()
        pieces = corpus_pipeline.pack_tokens(spark, docs, sf).collect()
        assert len(pieces) >= left
