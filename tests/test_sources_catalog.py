"""CSV ingest, header cleaning, versioned snapshots, undo, registry, metrics, delete, layers."""

import os
import random
import struct
import tempfile
import time
import zlib
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tessera.operators import models as md
from tessera.sources import files as fs
from tessera.sources.catalog import Catalog
from tessera.sources.commits import Files, VersionedTable


def test_csv_nulls_header_and_types(spark):
    d = tempfile.mkdtemp(prefix="tessera-csv-")
    p = os.path.join(d, "dirty.csv")
    with open(p, "w") as f:
        f.write(" a b ,c,d\n1,x,2.5\n?,NA,\n3,\"q, r\",4\n")
    df = fs.read_csv(spark, p)
    assert df.columns == ["a_b", "c", "d"]
    assert dict(df.dtypes) == {"a_b": "bigint", "c": "string", "d": "double"}
    rows = sorted(df.collect(), key=lambda r: (r.a_b is None, r.a_b))
    assert rows[0].a_b == 1 and rows[1].c == "q, r" and rows[2].a_b is None
    assert rows[2].c is None and rows[2].d is None


def test_texts_are_told_from_numbers_as_by_casting_each(spark):
    rng = random.Random(6)
    odd = ["0x1p3", "-0X1.8P-2d", "1e5", "1e400", "1.", ".5", "+.5E-3f", "5D", "NaN", "-inf", "+Infinity", "\t12\n", "\x7f7", " 7\x1c",
           "9223372036854775807", "9223372036854775808", "--1", "+", ".", "e5", "1 2", "12\u00a0", "\u0663", "1_0", "é1", "", "infin", "nanf"]
    texts = odd + ["".join(rng.choice("0123456789+-.eExXpPdDfF naiNIty\n\x0b") for _ in range(rng.randint(1, 6))) for _ in range(20_000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for kind in ("long", "double"):
        wrong = df.where(fs._no_number(F.col("t"), kind) != F.col("t").try_cast(kind).isNull())
        assert wrong.collect() == []


def test_a_column_of_texts_takes_about_as_long_as_one_of_numbers(spark):
    took = {}
    for name, one in {"warm": "1", "number": "1", "text": "R"}.items():
        df = spark.range(600_000, numPartitions=4).select(F.concat(F.lit(one), F.when(F.col("id") < 0, "x").otherwise("")).alias("c"))
        began = time.perf_counter()
        assert fs.infer_types(df) == {"c": "string" if name == "text" else "long"}
        took[name] = time.perf_counter() - began
    assert took["text"] < 3 * took["number"] + 1


def test_cash_csv_dates(spark):
    d = tempfile.mkdtemp(prefix="tessera-csv-")
    p = os.path.join(d, "cash.csv")
    with open(p, "w") as f:
        f.write("posted_date,billing_entity,total_payments\n2020-01-05,A,10\nbad,A,5\n")
    df = fs.read_cash_csv(spark, p)
    got = sorted((str(r.posted_date), r.total_payments) for r in df.collect())
    assert got == [("2020-01-05", 10), ("None", 5)]


def test_preview_pages(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    assert [r.k for r in fs.preview(df, ["k"], 5, 10).collect()] == [10, 11, 12, 13, 14]


def test_versions_undo_and_original(spark):
    cat = Catalog(spark, tempfile.mkdtemp(prefix="tessera-cat-"))
    v0 = spark.range(3)
    cat.save("ds1", v0)
    cat.save("ds1", v0.filter("id > 0"))
    assert cat.load("ds1").count() == 2
    cat.undo("ds1")
    assert cat.load("ds1").count() == 3
    cat.undo("ds1")  # only one level
    assert cat.load("ds1").count() == 3
    cat.save("ds1", cat.load("ds1").filter("id = 2"))  # reads the current version, writes v2
    assert cat.load("ds1").count() == 1
    assert cat.original("ds1").count() == 3


def test_registry_metrics_delete_layers(spark):
    cat = Catalog(spark, tempfile.mkdtemp(prefix="tessera-cat-"))
    ids = [cat.create_project(f"p{i}", "Data Processing") for i in range(12)]
    assert ids == list(range(1, 13))
    cat.upsert_metrics(1, "Decision Tree", 0.9, 0.8, 0.8, "y")
    cat.upsert_metrics(1, "Decision Tree", 0.95, 0.85, 0.85, "y")
    cat.upsert_metrics(12, "Random Forest", 0.7, 0.6, 0.6, "y")
    cat.publish(1, "Decision Tree", "DT1", "/models/DT1")
    ml = cat.model_list(1).collect()
    assert len(ml) == 1 and ml[0].test_accuracy == 0.85 and ml[0].model_id == "DT1"
    assert cat.add_layer(1, "Conv2D", "f=8") == 1
    assert cat.add_layer(1, "MaxPool", "p=2") == 2
    with pytest.raises(ValueError):
        cat.delete_layer(1, 1)
    cat.delete_project(1)
    assert cat.model_list(1).count() == 0
    assert cat.model_list(12).count() == 1          # id 12 survives deleting id 1
    assert [r.project_id for r in cat.active_projects().collect()].count(1) == 0
    assert cat.layers(1).count() == 0


def test_racing_writers_lose_nothing(spark):
    root = tempfile.mkdtemp(prefix="tessera-cat-")

    def work(k):
        cat = Catalog(spark, root)
        return [cat.create_project(f"w{k}-{i}", "Data Processing") for i in range(4)]
    with ThreadPoolExecutor(4) as pool:
        ids = [i for part in pool.map(work, range(4)) for i in part]
    cat = Catalog(spark, root)
    assert sorted(ids) == list(range(1, 17))
    assert sorted(r.name for r in cat.active_projects().collect()) == sorted(f"w{k}-{i}" for k in range(4) for i in range(4))


def test_a_crash_before_the_commit_leaves_the_old_version(spark, monkeypatch):
    cat = Catalog(spark, tempfile.mkdtemp(prefix="tessera-cat-"))
    cat.save("ds", spark.range(3))

    def crash(*_a, **_k):
        raise OSError("gone")
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", crash)
        with pytest.raises(OSError):
            cat.save("ds", spark.range(9))
    assert cat.load("ds").count() == 3 and cat.original("ds").count() == 3
    # an error while reading the log is no empty table
    with monkeypatch.context() as m:
        m.setattr(Files, "read", crash)
        with pytest.raises(OSError):
            cat.save("ds", spark.range(9))
    assert cat.load("ds").count() == 3
    cat.save("ds", spark.range(5))
    assert cat.load("ds").count() == 5
    cat.undo("ds")
    assert cat.load("ds").count() == 3


def test_create_is_exclusive(spark):
    files, path = Files(spark), os.path.join(tempfile.mkdtemp(), "a", "x.json")
    assert files.create(path, "one") and not files.create(path, "two") and files.read(path) == "one"
    assert files.names(os.path.dirname(path)) == ["x.json"]


def test_parameters_are_saved_edited_and_used(spark):
    cat = Catalog(spark, tempfile.mkdtemp(prefix="tessera-cat-"))
    assert cat.parameters(1, "Decision Tree") == {}
    cat.save_parameters(1, "Decision Tree", {"max_depth": 1, "criterion": "entropy"})
    cat.save_parameters(12, "Decision Tree", {"max_depth": 9})
    assert cat.edit_parameters(1, "Decision Tree", max_depth=2) == {"max_depth": 2, "criterion": "entropy"}
    assert cat.parameters(12, "Decision Tree") == {"max_depth": 9}
    df = spark.range(200).selectExpr("id", "double(id % 8) x", "int(id % 8 in (1, 2, 5)) l")
    model, _ = md.train_classifier(df, "id", ["x"], "l", "Decision Tree", cat.parameters(1, "Decision Tree"))
    assert model.stages[-1].depth == 2 and model.stages[-1].getImpurity() == "entropy"


def _all_files(root):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs)


def test_delete_leaves_nothing_and_can_be_resumed(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="tessera-cat-")
    cat = Catalog(spark, root)
    ids = [cat.create_project(f"p{i}", "Data Processing") for i in range(12)]
    df = spark.range(40).selectExpr("id", "double(id) x", "int(id > 20) l")
    for i in (1, 12):
        cat.save(cat.dataset(i), df)
        cat.save(cat.dataset(i), df.limit(5))
        model, _ = md.train_classifier(df, "id", ["x"], "l", "Decision Tree")
        md.publish_model(model, cat.model_path(i, f"DT{i}"), None, i, "Decision Tree", spark)
        cat.publish(i, "Decision Tree", f"DT{i}", cat.model_path(i, f"DT{i}"))
        cat.upsert_metrics(i, "Decision Tree", 0.9, 0.8, 0.8, "l")
        cat.save_parameters(i, "Decision Tree", {"max_depth": i})
        cat.add_layer(i, "Conv2D", "f=8")
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "forget", lambda self: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            cat.delete_project(1)
    assert cat.resume_deletes() == [1] and cat.resume_deletes() == []
    cat.delete_project(1)                       # once more changes nothing
    assert not [f for f in _all_files(root) if f"project-1{os.sep}" in f]
    for name in ("metrics", "published", "layers", "parameters"):
        folder = os.path.join(root, name)
        kept = [n for n in os.listdir(folder) if n.startswith("data-")]
        assert len(kept) == 1
        assert {r.project_id for r in spark.read.parquet(os.path.join(folder, kept[0])).collect()} == {12}
    assert cat.load(cat.dataset(12)).count() == 5 and cat.original(cat.dataset(12)).count() == 40
    assert cat.model_list(12).count() == 1 and os.path.isdir(cat.model_path(12, "DT12"))
    assert sorted(r.project_id for r in cat.active_projects().collect()) == ids[1:]
    with pytest.raises(KeyError):
        cat.load(cat.dataset(1))


def _png(path, w, h, rgb):
    raw = b"".join(b"\x00" + b"".join(bytes(rgb(x, y)) for x in range(w)) for y in range(h))

    def chunk(t, data):
        c = struct.pack(">I", len(data)) + t + data
        return c + struct.pack(">I", zlib.crc32(t + data) & 0xFFFFFFFF)
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) \
        + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    with open(path, "wb") as f:
        f.write(png)


@pytest.fixture(scope="module")
def image_dir():
    root = tempfile.mkdtemp(prefix="tessera-img-")
    for cls, col in (("red", (200, 10, 10)), ("blue", (10, 10, 200))):
        d = os.path.join(root, "train", cls)
        os.makedirs(d)
        for i in range(3):
            _png(os.path.join(d, f"{i}.png"), 12, 10, lambda x, y, c=col, i=i: (
                min(c[0] + x * i, 255), c[1] + y, c[2]))
    with open(os.path.join(root, "train", "red", "broken.png"), "wb") as f:
        f.write(b"not an image")
    return root


def test_image_source_labels_and_corrupt_file(spark, image_dir):
    df = fs.read_images(spark, image_dir)
    got = {(r.label, r.set) for r in df.collect()}
    assert got == {("red", "train"), ("blue", "train")}
    assert df.count() == 6
