"""The stages one after another on the small documents."""

from pyspark.sql import DataFrameWriter

import corpus_pipeline


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    df, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, d).persist()
        assert df.columns == docs.columns, name
        sizes.append(df.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[1] > 0.6 * sizes[0] and sizes[3] == sizes[4]
    last = corpus_pipeline.STAGES[-1][1](spark, df, d)
    assert last.select("doc_id").distinct().count() == sizes[4]
    assert corpus_pipeline.run(spark, d).count() == last.count()


def test_stages_hold_batches(spark, monkeypatch):
    """All Python code of a stage runs within it, in batches of 1,000 rows at most; the setting is restored."""
    name, d, sizes = "spark.sql.execution.arrow.maxRecordsPerBatch", "/root/testdata/sf0.001", []
    python = lambda df: "Pandas" in df._jdf.queryExecution().executedPlan().toString()
    write, collect = DataFrameWriter.parquet, type(spark.range(0)).collect

    def note(df):
        if python(df):
            sizes.append(int(spark.conf.get(name)))

    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: (note(self._df), write(self, *a, **b))[1])
    monkeypatch.setattr(type(spark.range(0)), "collect", lambda self: (note(self), collect(self))[1])
    df, before = spark.read.parquet(f"{d}/documents.parquet"), spark.conf.get(name)
    for stage, f in corpus_pipeline.STAGES:
        sizes.clear()
        df = f(spark, df, d)
        assert sizes and max(sizes) <= 1_000 and not python(df), stage
        assert spark.conf.get(name) == before, stage
