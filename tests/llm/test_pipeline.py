"""The pipeline's stages, each on what the one before kept."""

import sys
from pathlib import Path
from urllib.parse import urlparse

from corvida.llm import decontamination, exact_dedup, ngram_join, packing, queries, toxicity
from corvida.llm.common import commonest
from corvida.session import shared_dir

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("labels", "benchmark"))
    columns, before = docs.columns, {r["doc_id"] for r in docs.collect()}
    gone = [
        lambda d: {r["doc_id"] for r in toxicity.score_documents(d, labels).where("predicted = 1").collect()},
        lambda d: {r["doc_id"] for r in exact_dedup.exact_groups(d).where("not kept").collect()},
        lambda d: {r["doc_id"] for r in ngram_join.linked_components(d).where("doc_id <> component_id").collect()},
        lambda d: {r["doc_id"] for r in decontamination.contained(d, items).collect()},
    ]
    for (_, stage), out in zip(corpus_pipeline.STAGES[:-1], gone, strict=True):
        want = before - out(docs)
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == want
        before = want
    packed = {tuple(r) for r in corpus_pipeline.run(spark, SMALL).select("doc_id", "start", "length", "ids_crc32").collect()}
    assert packed == {tuple(r) for r in packing.pack_documents(docs).select("doc_id", "start", "length", "ids_crc32").collect()}


def test_counted_shingles_leave_the_disk(spark):
    """While candidates are found and verified, the shingles that were only to be counted take no room."""
    folder = Path(urlparse(shared_dir(spark)).path, "corvida")
    before = set(folder.glob("signatures-*"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = ngram_join.linked_components(docs)
    (table,) = set(folder.glob("signatures-*")) - before
    assert list(table.glob("kind=0/*.parquet")) and not list(table.glob("kind=1/*"))
    assert found.count() == docs.count()


def test_the_table_of_frequencies_leaves_the_driver(spark):
    """Once candidates are found, its broadcast is gone: the driver goes on with many jobs."""
    held = lambda: {p for p in Path(spark.sparkContext._temp_dir).rglob("*") if p.is_file() and p.stat().st_size >= ngram_join.SLOTS}
    before = held()
    ngram_join.linked_components(spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert held() == before


def test_commonest_takes_a_job_a_page(spark):
    """As many jobs as pages, however many partitions there are; pages change no row."""
    counts = [n for n in range(1, 30) for _ in range(n % 4)]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(counts)], "i long, n long")
    for most in (0, 1, 2, 7, 20, 1_000):
        least = min((v for v in set(counts) if sum(n >= v for n in counts) <= most), default=99)
        want = {i for i, n in enumerate(counts) if n >= least}
        for page in (1, 3, 10_000):
            assert {r["i"] for r in commonest(rows, "n", most, page).collect()} == want
    context, names = spark.sparkContext, ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    was = [spark.conf.get(x) for x in names]
    try:
        for x, v in zip(names, ("60", "false"), strict=True):
            spark.conf.set(x, v)
        context.setJobGroup("commonest", "one page")
        commonest(rows, "n", 20)
        assert len(context.statusTracker().getJobIdsForGroup("commonest")) <= 4
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for x, v in zip(names, was, strict=True):
            spark.conf.set(x, v)


def test_same_rows_as_sql(spark):
    sys.path.insert(0, "tests")
    from comparing import of_duckdb, of_spark

    for name, sql in queries.SQL.items():
        assert of_spark(queries.QUERIES[name](spark, SMALL)) == of_duckdb(sql, SMALL)
