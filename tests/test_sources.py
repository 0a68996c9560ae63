"""Files written and read back, and the exact byte formats."""

import struct
import zlib

import numpy as np
import pytest
from conftest import collected, feature_table, image_table
from pyspark.sql import functions as F

from patchlight.layout import Shape
from patchlight.operators import convolve as cv
from patchlight.session import fresh_path, path_exists, shared_dir
from patchlight.sources import readers, writers
from patchlight.solvers import whitening


def test_feature_text_of_both_layouts(spark, tmp_path):
    for split, lines in (("train", ["(1.5,2,0)", "3,4.25,1"]), ("test", ["5,6,2"])):
        folder = tmp_path / f"layer_a_{split}_features"
        folder.mkdir()
        (folder / "part-00000").write_text("\n".join(lines) + "\n")
    rows = readers.read_feature_text(spark, str(tmp_path), "layer_a").collect()
    got = sorted((r["split"], r["label"], r["features"]) for r in rows)
    assert got == [("test", 2, [5.0, 6.0]), ("train", 0, [1.5, 2.0]), ("train", 1, [3.0, 4.25])]
    assert len({r["row_id"] for r in rows}) == 3
    narrowed = readers.feature_lines(spark, str(tmp_path / "layer_a_*_features"), as_float=True)
    assert narrowed.count() == 3 and narrowed.schema["features"].dataType.simpleString() == "array<double>"


def test_line_numbers_follow_files_and_blocks(spark, tmp_path):
    """Many splits per file and several files; numbers are dense and in order."""
    want = []
    for part in range(3):
        lines = [f"{part}-{i}" for i in range(500 * (part + 1))]
        (tmp_path / f"part-{part}").write_text("\n".join(lines) + "\n")
        want += lines
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = readers.numbered_lines(spark, str(tmp_path)).select("line_no", "value").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["value"] for r in sorted(rows)] == want
    assert sorted(r["line_no"] for r in rows) == list(range(len(want)))


def test_line_numbers_survive_another_split_of_the_files(spark, tmp_path):
    """Splits are planned anew between planning and reading; no line may be lost."""
    (tmp_path / "lines").write_text("".join(f"{i}\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.minPartitionNum", "4")
    try:
        table = readers.numbered_lines(spark, str(tmp_path))
        spark.conf.set("spark.sql.files.minPartitionNum", "7")
        rows = table.select("line_no", "value").collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert sorted((r["line_no"], int(r["value"])) for r in rows) == [(i, i) for i in range(20000)]


def test_long_matrix_files_come_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    (tmp_path / "m.csv").write_text("".join(f"{i},{-i}\n" for i in range(9000)))
    matrix = readers.read_matrix_lines(spark, str(tmp_path / "m.csv"))
    assert matrix.shape == (9000, 2) and np.array_equal(matrix[:, 0], np.arange(9000))
    monkeypatch.setattr(readers, "MODEL_VALUES", 100)
    with pytest.raises(ValueError, match="9000 lines"):
        readers.read_matrix_lines(spark, str(tmp_path / "m.csv"))


def test_photos_of_mixed_size_keep_theirs(spark):
    kind = "path string, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    rows = [("a", ("a", 1, 2, 3, 16, bytes(range(6)))), ("b", ("b", 2, 1, 1, 0, bytes([7, 8]))), ("c", ("c", -1, -1, -1, -1, b""))]
    table = spark.createDataFrame(rows, kind)
    got = {r["path"]: (r["width"], r["height"], r["n_channels"], r["pixels"]) for r in readers.decoded_pixels(table).collect()}
    assert got == {"a": (2, 1, 3, [2, 1, 0, 5, 4, 3]), "b": (1, 2, 1, [7, 8]), "c": (-1, -1, -1, None)}
    assert [r["path"] for r in readers.undecoded(table).collect()] == ["c"]


def test_fixed_records_with_planes(spark, tmp_path):
    shape = Shape(4, 3, 3)
    rng = np.random.default_rng(0)
    records = rng.integers(0, 256, size=(2500, 1 + shape.size), dtype=np.uint8)
    for part, block in enumerate(np.array_split(records, 2)):
        (tmp_path / f"data_{part}.bin").write_bytes(block.tobytes())
    rows = readers.read_fixed_records(spark, str(tmp_path), shape).toPandas()
    assert len(rows) == 2500 and rows["image_id"].is_unique
    want = records[:, 1:].reshape(-1, 3, 3, 4).transpose(0, 2, 3, 1).reshape(2500, -1) / 255.0
    want = sorted(np.column_stack([records[:, 0], want]).tolist())
    got = sorted(np.column_stack([rows["label"], np.stack(rows["pixels"])]).tolist())
    assert np.allclose(got, want)
    wide = readers.read_fixed_records(spark, str(tmp_path), Shape(5, 7, 1), label_bytes=2, planes=False).toPandas()
    assert set(wide["label"]) == {int(r[0]) * 256 + int(r[1]) for r in records}


def test_idx(spark, tmp_path):
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, size=(10000, 3, 5), dtype=np.uint8)
    labels = rng.integers(0, 10, size=10000, dtype=np.uint8)
    (tmp_path / "images").write_bytes(struct.pack(">iiii", 2051, 10000, 3, 5) + pixels.tobytes())
    (tmp_path / "labels").write_bytes(struct.pack(">ii", 2049, 10000) + labels.tobytes())
    table = readers.read_idx(spark, str(tmp_path / "images"), str(tmp_path / "labels"))
    rows = table.toPandas().sort_values("image_id")
    assert rows["image_id"].tolist() == list(range(10000)) and np.array_equal(rows["label"], labels)
    assert np.allclose(np.stack(rows["pixels"]), pixels.reshape(10000, -1) / 255.0)
    assert readers.idx_dimensions(spark, str(tmp_path / "images")) == Shape(5, 3, 1)
    with pytest.raises(Exception, match="2051"):
        readers.read_idx(spark, str(tmp_path / "labels"), str(tmp_path / "labels")).count()


def test_matrix_csv(spark, tmp_path):
    rows = np.random.default_rng(2).normal(size=(50, 64))
    np.savetxt(tmp_path / "X_train", rows, delimiter=",")
    np.savetxt(tmp_path / "y_train", np.arange(50) % 10, fmt="%d")
    table = readers.read_matrix_csv(spark, str(tmp_path / "X_train"), str(tmp_path / "y_train"))
    back = table.toPandas().sort_values("image_id")
    assert np.array_equal(np.stack(back["pixels"]), rows) and back["label"].tolist() == [i % 10 for i in range(50)]


def test_labelled_image_files(spark, tmp_path):
    """A tiny uncompressed bitmap per file; the class comes from the file's folder."""
    def bitmap(pixels):
        height, width = pixels.shape[:2]
        body = b"".join(row.astype(np.uint8).tobytes() + b"\0" * (-3 * width % 4) for row in pixels[::-1, :, ::-1])
        head = struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54)
        return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 0, 0, 0, 0) + body

    pixels = np.arange(18).reshape(2, 3, 3)
    for name in ("n01", "n02", "n99"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.bmp").write_bytes(bitmap(pixels))
    (tmp_path / "map").write_text("n01 12\nn02  7\n")
    labels = readers.read_label_map(spark, str(tmp_path / "map"))
    files = readers.read_labelled_files(spark, str(tmp_path), labels, r"/(n\d+)/", "*.bmp")
    assert sorted((r["key"], r["class"]) for r in files.select("key", "class").collect()) == [("n01", 12), ("n02", 7)]
    for row in readers.decoded_pixels(files).collect():
        assert row["pixels"] == list(range(18))
    listed = readers.list_files(spark, str(tmp_path), "*.bmp")
    assert listed.count() == 3 and "content" not in listed.columns


def bitmap(pixels, start=54, lines=None):
    height, width = pixels.shape[:2]
    body = b"".join(row.astype(np.uint8).tobytes() + b"\0" * (-3 * width % 4) for row in pixels[::-1, :, ::-1][:lines])
    head = struct.pack("<2sIHHI", b"BM", start + len(body), 0, 0, start)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 0, 0, 0, 0) + b"\0" * (start - 54) + body


def png(pixels):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 2, 0, 0, 0)
    lines = b"".join(b"\0" + row.astype(np.uint8).tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def image_rows(df):
    return sorted(tuple(r["image"]) for r in df.select("image").collect())


def test_image_files_of_all_kinds_are_those_of_the_image_source(spark, tmp_path, monkeypatch):
    """Plain bitmaps without the image source, which takes milliseconds a file; all others with it; folders in groups."""
    rng = np.random.default_rng(3)
    path = tmp_path / "all kinds"
    for k, (height, width) in enumerate(((1, 1), (2, 3), (5, 4), (3, 7))):
        folder = path / f"n0{k}" / "inner"
        folder.mkdir(parents=True)
        pixels = rng.integers(0, 256, size=(height, width, 3))
        (folder / f"a {k}%.bmp").write_bytes(bitmap(pixels))
        (folder / f"b{k}.BMP").write_bytes(bitmap(pixels) + b"\nbehind the pixels")
    assert "FileScan image" not in plan_of(readers.read_images(spark, str(path)))
    assert image_rows(readers.read_images(spark, str(path))) == image_rows(spark.read.format("image").option("recursiveFileLookup", True).load(str(path)))
    (path / "n01" / "inner" / "palette.bmp").write_bytes(bitmap(pixels, start=58))
    (path / "n01" / "inner" / "torn.bmp").write_bytes(bitmap(pixels, lines=1))
    (path / "n01" / "inner" / "head.bmp").write_bytes(bitmap(pixels)[:20])
    (path / "n02" / "inner" / "c.png").write_bytes(png(pixels))
    (path / "n02" / "inner" / "png.bmp").write_bytes(png(pixels))
    (path / "n03" / "inner" / "text").write_bytes(b"no image")
    (path / "_hidden").mkdir()
    (path / "_hidden" / "d.bmp").write_bytes(bitmap(pixels))
    source = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True)
    want = image_rows(source.load(str(path)))
    assert len(want) == 14 and sum(row[3] == -1 for row in want) >= 3
    assert image_rows(readers.read_images(spark, str(path))) == want
    assert image_rows(readers.read_images(spark, f"{path}/n0[12]")) == image_rows(source.load(f"{path}/n0[12]"))
    assert image_rows(readers.read_images(spark, str(path), "*.bmp")) == image_rows(source.option("pathGlobFilter", "*.bmp").load(str(path)))
    monkeypatch.setattr(readers, "LISTED_FILES", 5)
    assert len(readers.folder_groups(spark, str(path), 5)) >= 3
    assert image_rows(readers.read_images(spark, str(path))) == want


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_files_written_by_tasks_or_by_spark_read_alike(spark, tmp_path, monkeypatch):
    """A file for each pair of names; not a folder for each, since every folder is listed on its own."""
    pixels = np.random.default_rng(4).integers(0, 256, size=(40, 2, 3, 3))
    rows = [(f"n{i % 2}" if i else None, i, bytearray(bitmap(p))) for i, p in enumerate(pixels)]
    table = spark.createDataFrame([*rows, rows[7], rows[8]], "kind string, image bigint, content binary")
    labels = spark.createDataFrame([("n0", 5), ("n1", 6)], "key string, class int")

    def found(path):
        files = readers.read_labelled_files(spark, path, labels, r"/kind=(n\d+)/", "{image=*,part-*}")
        number = F.regexp_extract("path", r"/image=(\d+)", 1).cast("int")
        return sorted((r[0], r["class"], r["pixels"]) for r in readers.decoded_pixels(files).select(number, "class", "pixels").collect())

    want = [(i, 5 + i % 2, p.reshape(-1).tolist()) for i, p in enumerate(pixels) if i]
    for most in (100, 7):
        monkeypatch.setattr(writers, "FOLDER_FILES", most)
        writers.write_files(table, f"{tmp_path}/own{most}", "kind", "image", ".bmp")
        files = [p for p in (tmp_path / f"own{most}").rglob("*") if p.is_file()]
        assert len(files) == 40 and len({p.parent for p in files}) <= 3 * -(-42 // most)
        assert found(f"{tmp_path}/own{most}") == want
    with pytest.raises(ValueError, match="exists"):
        writers.write_files(table, f"{tmp_path}/own7", "kind", "image", ".bmp")
    monkeypatch.setattr(writers, "local_path", lambda spark, path: None)
    writers.write_files(table, f"{tmp_path}/spark", "kind", "image", ".bmp")
    assert found(f"{tmp_path}/spark") == want
    writers.write_files(table.where("image < 0"), f"{tmp_path}/none", "kind", "image", ".bmp")
    assert found(f"{tmp_path}/none") == []


def test_empty_tables_leave_an_empty_folder(spark, tmp_path):
    table = spark.createDataFrame([], "kind string, image bigint, content binary")
    writers.write_files(table, f"{tmp_path}/none", "kind", "image", ".bmp")
    assert readers.read_images(spark, f"{tmp_path}/none").count() == 0


def test_scores_and_datasets(spark):
    path = fresh_path(spark, "t")
    table = spark.createDataFrame([(7, 1, [0.1, -2.5e-11]), (8, 0, [1.0 / 3.0, 4.0])], "row_id bigint, label int, scores array<double>")
    writers.write_scores(table, f"{path}/scores")
    assert sorted(readers.read_scores(spark, f"{path}/scores").collect()) == sorted(table.collect())
    records = spark.createDataFrame([([1.0, 2.0], 1, [0.0, 1.0], "a")], readers.DATASET_FIELDS)
    writers.write_dataset(records, f"{path}/dataset")
    assert readers.read_dataset(spark, f"{path}/dataset").collect() == records.collect()


def test_layer_reload_gives_the_same_next_layer(spark):
    path = fresh_path(spark, "layer")
    table = image_table(spark, np.random.default_rng(3).normal(size=(20, 64)))
    first = cv.Layer(Shape(8, 8), 3, 4, pool=2, pool_stride=2)
    second = cv.Layer(first.out_shape, 2, 6, seed=1)
    stored = cv.layer_stack(table, [first]).withColumn("split", F.lit("train")).withColumn("label", F.col("image_id").cast("int"))
    writers.write_feature_text(stored, path, "id")
    again = readers.read_layer(spark, path, "id", first.out_shape).withColumn("image_id", F.col("label").cast("bigint"))
    direct = collected(cv.layer_stack(table, [first, second]), "features")
    assert np.allclose(collected(cv.layer_stack(again.select("image_id", "pixels"), [second]), "features"), direct)
    with pytest.raises(Exception, match="row length"):
        readers.read_layer(spark, path, "id", Shape(2, 2, 2)).select("pixels").collect()


def test_whitener_files(spark, tmp_path):
    rows = np.random.default_rng(4).normal(size=(100, 9))
    model = whitening.fit_whitener(feature_table(spark, rows), epsilon=0.01)
    path = fresh_path(spark, "whitener")
    writers.write_whitener(spark, model, path)
    assert np.array_equal(writers.read_whitener(spark, path).matrix, model.matrix)
    np.savetxt(tmp_path / "matrix", model.matrix, delimiter=",")
    np.savetxt(tmp_path / "means", model.mean)
    imported = writers.import_whitener(spark, str(tmp_path / "matrix"), str(tmp_path / "means"))
    assert np.allclose(imported.matrix, model.matrix) and np.allclose(imported.mean, model.mean)
    assert np.allclose(imported.covariance, model.covariance + 0.01 * np.eye(9))


def test_materialize_computes_once(spark):
    path, calls = fresh_path(spark, "m"), []

    def compute():
        calls.append(1)
        return spark.range(5)

    assert writers.materialize(spark, path, compute).count() == 5
    assert writers.materialize(spark, path, compute).count() == 5 and len(calls) == 1
    writers.materialize(spark, path, compute, refresh=True)
    assert len(calls) == 2 and path_exists(spark, path)


def test_run_records_are_appended(spark):
    path = fresh_path(spark, "runs")
    for seed, filters in ((1, (5,)), (2, (5, 6))):
        writers.append_run(spark, {"features": {"seed": seed, "filters": filters}, "accuracy": 0.5, "note": 'a "b", c'}, path)
    runs = sorted((r["record"] for r in writers.read_runs(spark, path).collect()), key=lambda r: r["features_seed"])
    common = {"accuracy": "0.5", "note": 'a "b", c', "features_filters_0": "5"}
    assert runs == [{**common, "features_seed": "1"}, {**common, "features_seed": "2", "features_filters_1": "6"}]


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_records_of_files_keep_their_ids_under_any_split(spark, tmp_path):
    rng = np.random.default_rng(5)
    shape = Shape(3, 1, 1)
    files = {f"part-{k}": rng.integers(0, 256, size=(n, 4), dtype=np.uint8) for k, n in enumerate((1, 7, 1000))}
    for name in sorted(files, reverse=True):
        (tmp_path / name).write_bytes(files[name].tobytes())
    want = {k * readers.FILE_RECORDS + i: r.tolist() for k, name in enumerate(sorted(files)) for i, r in enumerate(files[name])}
    for most in ("128m", "64"):
        spark.sparkContext._jsc.hadoopConfiguration().set("mapreduce.input.fileinputformat.split.maxsize", {"128m": str(1 << 27)}.get(most, most))
        rows = readers.read_fixed_records(spark, str(tmp_path), shape, planes=False).collect()
        assert {r.image_id: [r.label, *np.rint(np.array(r.pixels) * 255).astype(int).tolist()] for r in rows} == want
    spark.sparkContext._jsc.hadoopConfiguration().unset("mapreduce.input.fileinputformat.split.maxsize")
    (tmp_path / "odd").write_bytes(b"12345")
    with pytest.raises(ValueError, match="odd"):
        readers.read_fixed_records(spark, str(tmp_path), shape)


@pytest.mark.parametrize("piece", [1, 5, 64, 1 << 16])
def test_idx_records_that_lie_in_two_pieces(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(readers, "PIECE_BYTES", piece)
    pixels = np.random.default_rng(6).integers(0, 256, size=(40, 3, 5), dtype=np.uint8)
    (tmp_path / "images").write_bytes(struct.pack(">iiii", 2051, 40, 3, 5) + pixels.tobytes() + b"tail")
    (tmp_path / "labels").write_bytes(struct.pack(">ii", 2049, 40) + bytes(range(40)))
    rows = readers.read_idx(spark, str(tmp_path / "images"), str(tmp_path / "labels")).toPandas().sort_values("image_id")
    assert rows["label"].tolist() == list(range(40)) and np.allclose(np.stack(rows["pixels"]) * 255, pixels.reshape(40, -1))
    (tmp_path / "short").write_bytes(struct.pack(">iiii", 2051, 41, 3, 5) + pixels.tobytes())
    with pytest.raises(ValueError, match="too few"):
        readers.read_idx(spark, str(tmp_path / "short"), str(tmp_path / "labels"))


def test_line_numbers_are_summed_on_two_levels(spark, tmp_path, monkeypatch):
    plans = []
    keep = readers.written
    monkeypatch.setattr(readers, "written", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or keep(df, name))
    for part in range(20):
        (tmp_path / f"p{part:02d}").write_text("".join(f"{part}-{k}\n" for k in range(part)))
    rows = readers.numbered_lines(spark, str(tmp_path)).collect()
    want = [f"{part}-{k}" for part in range(20) for k in range(part)]
    assert [r["value"] for r in sorted(rows, key=lambda r: r["line_no"])] == want and sorted(r["line_no"] for r in rows) == list(range(len(want)))
    windows = [w for p in plans for w in p.split("windowspecdefinition(")[1:]]
    assert windows and all(w.startswith(("path", "part")) for w in windows)
