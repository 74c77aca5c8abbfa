"""Sources, sinks, project state, images (tiny PNGs made here) and streaming."""

import os
import struct
import zlib

from pyspark.sql import functions as F

from tabwise.operators.images import image_clean_summary, resize_normalize
from tabwise.sources import io as IO
from tabwise.sources import projects as PJ
from tabwise.sources.images import load_images, scan_images, validate_images


def _png(path, w, h, rgb):
    raw = b"".join(b"\x00" + bytes(rgb) * w for _ in range(h))
    color_type = 6 if len(rgb) == 4 else 2

    def chunk(t, d):
        return struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d) & 0xFFFFFFFF)
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color_type, 0, 0, 0)) + \
        chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    with open(path, "wb") as f:
        f.write(data)


def test_csv_tokens_and_types(spark, tmp_dir):
    p = os.path.join(tmp_dir, "x.csv")
    with open(p, "w") as f:
        f.write("a,b,c,d\n1,1.5,x,true\nNA,N/A,null,false\n3,,y,True\n")
    df = IO.read_csv(spark, p)
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "string", "d": "boolean"}
    rows = df.collect()
    assert rows[1]["a"] is None and rows[1]["b"] is None and rows[1]["c"] is None
    try:
        IO.read_csv_ui(spark, os.path.join(tmp_dir, "x.txt"))
        raise AssertionError("expected NotCsv")
    except IO.NotCsv:
        pass


def test_from_records(spark):
    df = IO.from_records(spark, [{"a": 1, "b": "x"}, {"a": 2}])
    assert df.count() == 2 and df.columns == ["a", "b"]
    try:
        IO.from_records(spark, [])
        raise AssertionError("expected EmptyDataset")
    except IO.EmptyDataset:
        pass


def test_project_state_roundtrip(spark, tmp_dir):
    cv = spark.createDataFrame([(1, "A", 0.9), (1, "B", 0.8), (2, "C", 0.7)], "project_id int, model_name string, f1_mean double")
    tb = spark.createDataFrame([(1, "A", 0.91, 0.9, 0.9, 0.9), (1, "B", 0.8, 0.8, 0.8, 0.8), (2, "C", 0.7, 0.7, 0.7, 0.7)],
                               "project_id int, model_name string, accuracy double, f1 double, precision double, recall double")
    sel = spark.createDataFrame([(1, "A"), (2, "C")], "project_id int, model_name string")
    root = os.path.join(tmp_dir, "projects")
    PJ.write_project_state(PJ.project_states(cv, tb, sel, "classification"), root)
    assert [r[0] for r in PJ.list_projects(PJ.read_project_states(spark, root)).collect()] == [1, 2]
    one = PJ.read_project_state(spark, root, 1)
    assert PJ.project_summary(one).first()["accuracy"] == 0.91
    assert PJ.read_project_state(spark, root, 99) is None
    lines = PJ.report_lines(PJ.project_summary(PJ.read_project_states(spark, root)))
    PJ.write_report_text(lines, os.path.join(tmp_dir, "reports"))
    txt = PJ.read_report_text(spark, os.path.join(tmp_dir, "reports"), 2)
    assert txt.startswith("Project: 2\nTask type: classification\nBest model: C\nTest accuracy: 70.00%")


def test_images(spark, tmp_dir):
    root = os.path.join(tmp_dir, "imgs")
    os.makedirs(os.path.join(root, "cats"))
    os.makedirs(os.path.join(root, "dogs"))
    _png(os.path.join(root, "cats", "cat.1.png"), 4, 3, (255, 0, 0))
    _png(os.path.join(root, "dogs", "x1.png"), 224, 224, (0, 0, 255))
    with open(os.path.join(root, "dogs", "broken.png"), "wb") as f:
        f.write(b"not an image")
    with open(os.path.join(root, "notes.txt"), "w") as f:
        f.write("x")
    items = {r["relative_path"]: r["label"] for r in scan_images(spark, root).collect()}
    assert items == {"cats/cat.1.png": "cat", "dogs/x1.png": "dogs", "dogs/broken.png": "broken"}
    imgs = load_images(spark, root)
    v = validate_images(imgs).first()
    assert (v["valid"], v["rejected"]) == (2, 1)
    red = imgs.filter(F.col("path").contains("cat.1")).first()
    assert bytes(red["data"][:3]) == bytes([0, 0, 255])              # BGR order
    t = resize_normalize(imgs, size=8).collect()
    assert all(len(r["tensor"]) == 3 * 8 * 8 for r in t)
    s = image_clean_summary(resize_normalize(imgs, size=8)).first()
    assert (s["before"], s["after"], s["corrupted"], s["resized"]) == (3, 2, 1, 2)


def test_streaming_scores_equal_batch(spark, tmp_dir):
    from tabwise.operators.ml import zoo
    from tabwise.plans.automl import run_automl
    from tabwise.streaming.scoring import score_stream, stream_source
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select(
        "o_orderkey", "o_totalprice", "o_orderpriority",
        F.when(F.col("o_totalprice") > 250000, "high").otherwise("low").alias("band"))
    run = run_automl(o, "band", "o_orderkey", "classification",
                     models={"Naive Bayes": zoo.OPTIONAL_CLASSIFIERS["Naive Bayes"]}, cv_folds=3)
    src = os.path.join(tmp_dir, "in")
    o.drop("band").repartition(3).write.parquet(src)
    stream = stream_source(spark, src, o.drop("band").schema)
    q = score_stream(run.predictor(), stream, probabilities=False).writeStream.format("memory") \
        .queryName("scored_orders").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    s = spark.table("scored_orders")
    b = run.predictor().predict(o.drop("band"), probabilities=False)
    assert s.count() == o.count()
    diff = s.join(b.withColumnRenamed("band_prediction", "bp"), "o_orderkey").filter("band_prediction <> bp").count()
    assert diff == 0


def test_ui_image_rule(spark, tmp_dir):
    from tabwise.operators.images import image_preview
    root = os.path.join(tmp_dir, "ui")
    os.makedirs(root)
    _png(os.path.join(root, "clear_1.png"), 6, 4, (10, 20, 30, 0))          # fully transparent -> white
    imgs = load_images(spark, root)
    t = resize_normalize(imgs, size=4, ui=True).first()
    assert all(abs(v - 1.0) < 1e-6 for v in t["tensor"])                    # white, cropped, [0, 1]
    assert image_preview(resize_normalize(imgs, size=4, ui=True), 8).count() == 1


def test_written_images_are_read_back(spark, tmp_path):
    from tabwise.sources.images import load_images, write_images
    root = str(tmp_path / "made")
    rows = [("a/x.png", 2, 1, 3, bytearray([1, 2, 3, 250, 0, 9])), ("a/y.png", 1, 2, 1, bytearray([7, 8])),
            ("b/short.png", 2, 2, 3, bytearray([1, 2])), ("b/none.png", 2, 2, 3, None)]
    images = spark.createDataFrame(rows, "relative_path string, width int, height int, channels int, pixels binary")
    assert write_images(images.repartition(3), root) == 4 and write_images(images, root) == 4  # again: the same files
    got = {r["path"].split("made/")[1]: r for r in load_images(spark, root).collect()}
    assert len(got) == 4 and bytes(got["a/x.png"]["data"]) == bytes([3, 2, 1, 9, 0, 250])  # BGR
    assert bytes(got["a/y.png"]["data"]) == bytes([7, 8]) and got["a/y.png"]["height"] == 2
    assert got["b/short.png"]["height"] == -1 and got["b/none.png"]["height"] == -1
    assert write_images(images.limit(0), str(tmp_path / "no")) == 0
