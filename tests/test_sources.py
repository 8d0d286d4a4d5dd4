"""Labelled sources, manifests and rewritten batches, written and read back."""

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources import io


def test_files(spark, tmp_path):
    for name, content in (("a.pdf", b"%PDF-1.7 x"), ("b.pdf", b"plain"), ("c.pdf", b"%PD")):
        (tmp_path / name).write_bytes(content)
    good, bad = io.scan_files(spark, str(tmp_path))
    assert [r["path"].rsplit("/", 1)[1] for r in good.collect()] == ["a.pdf"]
    assert {(r["path"].rsplit("/", 1)[1], r["problem"]) for r in bad.collect()} == {("b.pdf", "not_pdf"), ("c.pdf", "not_pdf")}
    sizes = spark.createDataFrame([("x",)] * 60 + [("y",)] * 61, "batch string")
    assert {r["batch"]: r["ok"] for r in io.batch_size_ok(sizes).collect()} == {"x": True, "y": False}


def test_labelled_folder(spark, tmp_path):
    texts = tmp_path / "texts"
    texts.mkdir()
    for name, content in (("one.txt", "first\nsecond\n"), ("two.txt", ""), ("three.txt", "not named")):
        (texts / name).write_text(content)
    (tmp_path / "labels.csv").write_text("filename,label\none.txt,ai-generated\ntwo.txt,human\nmissing.txt,human\n")
    got = {r["filename"]: (r["y"], r["text"]) for r in io.scan_labelled_folder(spark, str(tmp_path / "labels.csv"), str(texts)).collect()}
    assert got == {"one.txt": (1, "first\nsecond\n")}


def test_labelled_csv(spark, tmp_path):
    (tmp_path / "in.csv").write_text('text,label\n"One line, with a comma.\nAnd ""another"" line.",1\n"...",0\nplain text here.,0\n,1\nno label,\n')
    rows = io.scan_labelled_csv(spark, str(tmp_path / "in.csv"))
    assert {(r["text"], r["label"]) for r in rows.collect()} == {('One line, with a comma.\nAnd "another" line.', 1), ("...", 0), ("plain text here.", 0)}
    io.write_features(rows, str(tmp_path / "out"), T.stylometric_features)
    out = spark.read.csv(str(tmp_path / "out"), header=True, inferSchema=True)
    assert out.columns == ["ttr", "avg_sent_len", "punct_density", "stylometric_score", "label"]
    assert sorted(r["label"] for r in out.collect()) == [0, 1]  # the row without words gives no style


def test_manifest_and_formats(spark, tmp_path):
    rows = spark.createDataFrame([("b", 1), ("b", 2)], "batch string, n int")
    for fmt in ("csv", "json", "parquet"):
        io.write_export(rows, f"{tmp_path}/{fmt}", fmt, f"{tmp_path}/manifest", "b", "u1")
        back = spark.read.option("header", "true").format(fmt).load(f"{tmp_path}/{fmt}")
        assert sorted(int(r["n"]) for r in back.collect()) == [1, 2]
    manifest = spark.read.parquet(f"{tmp_path}/manifest").orderBy("generated_at").collect()
    assert [(r["batch"], r["format"], r["generated_by"]) for r in manifest] == [("b", f, "u1") for f in ("csv", "json", "parquet")]


def test_a_rerun_replaces_its_batch(spark, tmp_path):
    path = f"{tmp_path}/pairs"
    io.overwrite_batches(spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "batch string, n int"), path)
    for _ in range(2):
        io.overwrite_batches(spark.createDataFrame([("x", 9)], "batch string, n int"), path)
    assert sorted((r["batch"], r["n"]) for r in spark.read.parquet(path).collect()) == [("x", 9), ("y", 3)]


def test_cascade(spark):
    gone = spark.createDataFrame([("x",)], "batch string")
    tables = {k: spark.createDataFrame([("x", i), ("y", i)], "batch string, n int") for i, k in enumerate(("docs", "pairs", "risks", "results", "annotations", "exports"))}
    left = io.delete_batches(tables, gone)
    assert set(left) == set(tables) and all([r["batch"] for r in t.collect()] == ["y"] for t in left.values())


def test_small_inputs_are_dealt_out(spark, tmp_path, monkeypatch):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    used = lambda df: df.groupBy(F.spark_partition_id()).count().count()
    assert used(io.spread(rows)) == spark.sparkContext.defaultParallelism and io.spread(rows).count() == 1000
    assert used(io.spread(rows.where("id < 0"))) == 0
    monkeypatch.setattr(io, "ROW_GROUP", 1)
    assert io.spread(rows) is rows
