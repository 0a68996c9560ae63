"""Readers for the stored forms of images, features, labels and scores.

Every reader returns keyed rows. None reads a file on the driver.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import RDD, inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlight.functions.batches import MODEL_VALUES, VECTOR, from_matrix
from patchlight.layout import Shape, with_shape
from patchlight.operators.joins import label_files, pair_rows
from patchlight.session import fresh_path, path_exists, store_of, written

# Fixed values of the formats: IDX magic numbers and header lengths, bytes per pixel value.
IDX_IMAGES, IDX_IMAGES_HEADER = 2051, 16
IDX_LABELS, IDX_LABELS_HEADER = 2049, 8
BYTE_SCALE = 255.0

# Bytes that travel together from the file to the decoder, and how far the ids of two files lie apart.
PIECE_BYTES = 1 << 16
FILE_RECORDS = 1 << 40

# Files that the driver lists together (0.7 KB each), where folders let them be told apart, folders in one folder
# that it counts for that, lists that it makes at a time, and tasks that read the files of one at least.
LISTED_FILES = 50_000
COUNTED_FOLDERS = 5_000
LISTINGS = 4
READ_TASKS = 32

# Names of files that may be plain bitmaps, and what their header holds: mark, start of the pixels, length of the
# second header, width, height, planes, bits and compression. Mode of the image source for three channels of bytes.
BITMAP_NAME = r"\.(bmp|dib)$"
BITMAP_HEAD = "<2s8xIIiiHHI"
BITMAP_PIXELS = 54
THREE_BYTES = 16

LINE_KEYS = ("path", "block_start")


def placed_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text lines as (row, path, block_start, value); ``row`` is unique in this one scan and grows along each block."""
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block_start"),
    ).withColumn("row", F.monotonically_increasing_id())


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text lines as (line_no, path, value); numbers run on over files in path order.

    The lines are read by one scan and written with the block they were read in,
    so counting the blocks and numbering the lines see the same split of the
    files, whatever later jobs would plan. Numbers are sums on two levels: files
    are counted up in ranges of paths, of which only one sum each reaches the
    driver, and blocks within their file.
    """
    lines = written(placed_lines(spark, path), "lines")
    blocks = written(lines.groupBy(*LINE_KEYS).agg(F.count("*").alias("n"), F.min("row").alias("first_row")), "blocks")
    files = blocks.groupBy("path").agg(F.sum("n").alias("n")).repartitionByRange("path").withColumn("part", F.spark_partition_id())
    files = written(files, "files")
    ranges = dict(files.groupBy("part").agg(F.sum("n").alias("n")).collect())
    starts, held = [0] * (max(ranges, default=0) + 1), 0
    for part in sorted(ranges):
        starts[part], held = held, held + ranges[part]
    earlier = lambda part, order: Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda window: F.coalesce(F.sum("n").over(window), F.lit(0).cast("bigint"))
    first_of_file = F.get(F.lit(starts).cast("array<bigint>"), F.col("part")) + before(earlier("part", "path"))
    placed = files.select("path", first_of_file.alias("file_line"))
    offsets = blocks.select(*LINE_KEYS, "first_row", before(earlier("path", "block_start")).alias("block_line")).join(placed, "path")
    offsets = written(offsets.select(*LINE_KEYS, "first_row", (F.col("file_line") + F.col("block_line")).alias("first_line")), "blocks")
    number = F.col("first_line") + F.col("row") - F.col("first_row")
    return lines.join(offsets, list(LINE_KEYS)).select(number.alias("line_no"), "path", "value")


def parsed_numbers(value: Column, as_float: bool = False) -> Column:
    """Comma-separated numbers, parentheses ignored."""
    parts = F.split(F.regexp_replace(value, "[()]", ""), ",")
    numbers = F.transform(parts, lambda p: F.trim(p).cast("float" if as_float else "double"))
    return numbers.cast(VECTOR)


def read_feature_text(
    spark: SparkSession, path: str, feature_id: str, partitions: int | None = None, as_float: bool = False
) -> DataFrame:
    """Stored feature lines as (row_id, split, features, label).

    Reads ``<path>/<feature_id>_features/split={train,test}`` as our writer makes
    it, or the two directories ``<feature_id>_{train,test}_features``. The last
    field of a line is the label. ``as_float`` reads values as floats and widens
    them before any arithmetic.
    """
    ours = f"{path}/{feature_id}_features"
    if path_exists(spark, ours):
        source, pattern = ours, "/split=(train|test)/"
    else:
        source = [f"{path}/{feature_id}_{split}_features" for split in ("train", "test")]
        pattern = "_(train|test)_features/"
    both = feature_lines(spark, source, as_float).select(
        "row_id", F.regexp_extract("path", pattern, 1).alias("split"), "features", "label"
    )
    return both.coalesce(partitions) if partitions else both


def feature_lines(spark: SparkSession, path: str | list[str], as_float: bool = False) -> DataFrame:
    """Directories or globs of feature lines as (row_id, path, features, label), in one scan.

    Lines carry no key; ``row_id`` is unique within the table that is read, not
    dense, and not the same in another read.
    """
    numbers = placed_lines(spark, path).filter(F.length("value") > 0)
    parsed = numbers.select(
        F.col("row").alias("row_id"),
        "path",
        parsed_numbers(F.col("value"), as_float).alias("all"),
        F.element_at(F.split(F.regexp_replace("value", "[()]", ""), ","), -1).cast("double").cast("int").alias("label"),
    )
    return parsed.select("row_id", "path", F.slice("all", 1, F.size("all") - 1).alias("features"), "label")


def read_layer(
    spark: SparkSession, path: str, feature_id: str, shape: Shape, partitions: int | None = None
) -> DataFrame:
    """Stored features of a layer as images of that layer's shape."""
    stored = read_feature_text(spark, path, feature_id, partitions)
    return with_shape(stored, shape, "features").withColumnsRenamed({"features": "pixels", "row_id": "image_id"})


def file_sizes(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files at or below a path that hold anything, by path; one entry for each file is on the driver."""
    return [tuple(row) for row in list_files(spark, path).where("length > 0").orderBy("path").collect()]


def file_pieces(spark: SparkSession, path: str, length: int, unit: int = 1) -> RDD:
    """(first byte, bytes) of equal pieces of a file, each of whole units and at most PIECE_BYTES (or one unit).

    The fixed-length input format splits the file and says the number of each piece,
    so the pieces do not depend on the split, and no file is one value.
    """
    units = length // unit
    most = max(1, PIECE_BYTES // unit)
    piece = unit * max(d for k in range(1, int(units**0.5) + 1) if units % k == 0 for d in (k, units // k) if d <= most or d == 1)
    read = spark.sparkContext.newAPIHadoopFile(
        path, "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable",
        conf={"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(piece)},
    )
    return read.map(lambda pair: (pair[0] * piece, bytes(pair[1])))


def read_fixed_records(spark: SparkSession, path: str, shape: Shape, label_bytes: int = 1, planes: bool = True) -> DataFrame:
    """Fixed-width records (label bytes, then one byte per value) as (image_id, pixels, label).

    ``planes`` says that channels are stored one after the other, each in row
    order. Files are split at record boundaries. The id is the number of the record
    in its file plus FILE_RECORDS times the number of the file in path order, so it is
    the same however the files are split. Files must hold whole records.
    """
    length = label_bytes + shape.size
    files = file_sizes(spark, path)
    odd = [name for name, size in files if size % length]
    if odd:
        raise ValueError(f"{odd[0]} does not hold records of {length} bytes")

    def numbered(number: int, pieces: RDD) -> RDD:
        return pieces.map(lambda piece: (number * FILE_RECORDS + piece[0] // length, piece[1]))

    parts = [numbered(k, file_pieces(spark, name, size, length)) for k, (name, size) in enumerate(files)]
    packed = spark.sparkContext.union(parts) if parts else spark.sparkContext.emptyRDD()
    raw = spark.createDataFrame(packed, "first bigint, block binary")
    schema = T.StructType(
        [
            T.StructField("image_id", T.LongType()),
            T.StructField("pixels", VECTOR),
            T.StructField("label", T.IntegerType()),
        ]
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, packed_block in zip(batch.column(0).to_pylist(), batch.column(1)):
                block = np.frombuffer(packed_block.as_buffer(), np.uint8).reshape(-1, length)
                labels = np.zeros(len(block), np.int32)
                for k in range(label_bytes):
                    labels = labels * 256 + block[:, k]
                values = block[:, label_bytes:] / BYTE_SCALE
                if planes:
                    cube = values.reshape(-1, shape.channels, shape.height, shape.width)
                    values = cube.transpose(0, 2, 3, 1).reshape(len(block), -1)
                keys = pa.array(np.arange(first, first + len(block)), pa.int64())
                yield pa.RecordBatch.from_arrays([keys, from_matrix(values), pa.array(labels)], names=schema.names)

    return raw.mapInArrow(decode, schema)


def idx_header(spark: SparkSession, path: str, magic: int, header: int) -> tuple[int, list[int]]:
    """Bytes of an IDX file and the numbers of its header behind the magic one; only the header is read."""
    files = file_sizes(spark, path)
    if len(files) != 1 or files[0][1] < header:
        raise ValueError(f"{path} is not one IDX file")
    length = files[0][1]
    piece = math.gcd(header, length)
    head = spark.sparkContext.newAPIHadoopFile(
        path, "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable",
        conf={"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(piece)},
    ).take(header // piece)
    found, *numbers = np.frombuffer(b"".join(bytes(value) for _, value in head), ">u4").tolist()
    if found != magic:
        raise ValueError(f"{path} starts with {found}, not with {magic}")
    return length, numbers


def idx_records(spark: SparkSession, path: str, length: int, header: int, count: int, size: int) -> DataFrame:
    """(image_id, record) of the records of an IDX file, by their number.

    Pieces of the file are cut into records where they lie; a record that lies in
    two pieces is put together again from its parts by its number.
    """
    if length < header + count * size:
        raise ValueError(f"{path} has {length} bytes, too few for {count} records of {size}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"image_id": [], "at": [], "part": []}
            for start, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low, stop = max(start, header), min(start + len(block), header + count * size)
                while low < stop:
                    number, at = divmod(low - header, size)
                    high = min(stop, low - at + size)
                    out["image_id"].append(number)
                    out["at"].append(at)
                    out["part"].append(block[low - start : high - start])
                    low = high
            kinds = (pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    pieces = spark.createDataFrame(file_pieces(spark, path, length), "start bigint, block binary")
    parts = written(pieces.mapInArrow(cut, "image_id bigint, at bigint, part binary"), "records")
    whole = F.octet_length("part") == size
    torn = parts.where(~whole).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"))
    # A record has as many parts as pieces hold some of it.
    joined = F.aggregate("parts", F.lit(b""), lambda done, p: F.concat(done, p["part"]))
    return parts.where(whole).select("image_id", F.col("part").alias("record")).unionByName(torn.select("image_id", joined.alias("record")))


def read_idx(spark: SparkSession, image_path: str, label_path: str) -> DataFrame:
    """IDX images and labels of any size, joined on the record number, as (image_id, pixels, label)."""
    length, (count, height, width) = idx_header(spark, image_path, IDX_IMAGES, IDX_IMAGES_HEADER)
    images = idx_records(spark, image_path, length, IDX_IMAGES_HEADER, count, height * width)
    length, (count,) = idx_header(spark, label_path, IDX_LABELS, IDX_LABELS_HEADER)
    labels = idx_records(spark, label_path, length, IDX_LABELS_HEADER, count, 1)
    return pair_rows(unpack(images, "pixels"), unpack(labels, "label"), "image_id")


def unpack(records: DataFrame, out: str) -> DataFrame:
    """Records of one length to rows: values over 255 for pixels, the byte itself for labels."""
    pixels = out == "pixels"
    schema = T.StructType(
        [T.StructField("image_id", T.LongType()), T.StructField(out, VECTOR if pixels else T.IntegerType())]
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                block = np.frombuffer(b"".join(batch.column("record").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                values = from_matrix(block / BYTE_SCALE) if pixels else pa.array(block[:, 0].astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("image_id"), values], names=schema.names)

    return records.select("image_id", "record").mapInArrow(decode, schema)


def idx_dimensions(spark: SparkSession, image_path: str) -> Shape:
    """Height and width from the header of an IDX image file."""
    _, (_, height, width) = idx_header(spark, image_path, IDX_IMAGES, IDX_IMAGES_HEADER)
    return Shape(width, height, 1)


def read_matrix_csv(spark: SparkSession, x_path: str, y_path: str) -> DataFrame:
    """A matrix file and a label file paired by line number, as (image_id, pixels, label)."""
    x = numbered_lines(spark, x_path).select("line_no", parsed_numbers(F.col("value")).alias("pixels"))
    y = numbered_lines(spark, y_path).select("line_no", F.trim("value").cast("double").cast("int").alias("label"))
    return pair_rows(x, y, "line_no").withColumnRenamed("line_no", "image_id")


def folder_groups(spark: SparkSession, path: str, most: int) -> list[list[str]]:
    """Folders at or below a path in groups, which together hold every file that a reader of the path finds.

    A group holds at most ``most`` files, unless one folder alone holds more. A folder
    that holds files beside folders, or more than COUNTED_FOLDERS, is not split.
    """
    if not path_exists(spark, path):  # a pattern, or nothing
        return [[path]]
    at, store = spark._jvm.org.apache.hadoop.fs.Path, store_of(spark, path)

    def inner(folder: str) -> list[str]:
        found, inside = [], store.listStatus(at(folder))
        for status in inside if len(inside) <= COUNTED_FOLDERS else ():
            name = status.getPath().getName()
            if name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"):  # Spark's readers pass over these
                continue
            if not status.isDirectory() or set(name) & set("{}[]*?\\"):
                return []
            found.append(status.getPath().toString())
        return found

    def counted(folder: str) -> tuple[str, int, bool]:
        """The folder, the files below it, and whether it has folders."""
        summary = store.getContentSummary(at(folder))
        return folder, summary.getFileCount(), summary.getDirectoryCount() > 1

    def parts(folder: str) -> list[tuple[str, int]]:
        with ThreadPoolExecutor(LISTINGS) as pool:
            counts = list(pool.map(counted, inner(folder)))
        if not counts:
            return [(folder, most)]
        return [p for f, n, deep in counts for p in (parts(f) if deep and n > most else [(f, n)])]

    groups: list[list[str]] = []
    held = 0
    for folder, files in parts(path):
        if not groups or held + files > most:
            groups.append([])
            held = 0
        groups[-1].append(folder)
        held += files
    return groups if len(groups) > 1 else [[path]]


def plain_bitmap(content: bytes) -> tuple[int, int, bytes] | None:
    """Width, height and pixels (top row first, blue, green, red) of a bitmap of 24 bits without palette or compression; None for other files."""
    if len(content) < BITMAP_PIXELS:
        return None
    mark, start, head, width, height, planes, bits, packed = struct.unpack_from(BITMAP_HEAD, content)
    line = -(-3 * width // 4) * 4
    if (mark, start, head, planes, bits, packed) != (b"BM", BITMAP_PIXELS, 40, 1, 24, 0) or width < 1 or height < 1:
        return None
    if len(content) < BITMAP_PIXELS + line * height:
        return None
    lines = np.frombuffer(content, np.uint8, line * height, BITMAP_PIXELS).reshape(height, line)
    return width, height, lines[::-1, : 3 * width].tobytes()


IMAGE_PARTS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("height", "width", "nChannels", "mode")] + [T.StructField("data", T.BinaryType())])


def decode_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, content) to (file, height, width, nChannels, mode, data) as of the image source; nulls for what is no plain bitmap."""
    kinds = [pa.int32()] * 4 + [pa.binary()]
    for batch in batches:
        found = [plain_bitmap(content) for content in batch.column("content").to_pylist()]
        rows = [(None,) * 5 if x is None else (x[1], x[0], 3, THREE_BYTES, x[2]) for x in found]
        columns = [pa.array(v, kind) for v, kind in zip(zip(*rows), kinds)] if rows else [pa.array([], kind) for kind in kinds]
        yield pa.RecordBatch.from_arrays([batch.column("file"), *columns], names=["file", *IMAGE_PARTS.names])


def read_images(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Image files at or below a path as the rows (image) of Spark's image source; files that do not decode stay, with no channels.

    That source takes some 5 ms of CPU for a file however small, so files named as
    bitmaps are read as bytes, group by group of folders, and plain ones are
    decoded in Arrow batches and kept in the shared folder. The image source
    reads all others: those with other names, and bitmaps that are not plain.
    """

    def listed(kind: str, folders: list[str]) -> DataFrame:
        reader = spark.read.format(kind).option("recursiveFileLookup", True)
        if kind == "image":
            reader = reader.option("dropInvalid", False)
        if glob:
            reader = reader.option("pathGlobFilter", glob)
        return reader.load(folders)

    file, named = F.col("_metadata.file_path").alias("file"), F.lower("_metadata.file_name").rlike(BITMAP_NAME)
    kept = fresh_path(spark, "bitmaps")
    tasks = max(READ_TASKS, 4 * spark.sparkContext.defaultParallelism)
    groups = folder_groups(spark, path, LISTED_FILES)
    schema = T.StructType([T.StructField("file", T.StringType()), *IMAGE_PARTS])

    def keep(number: int) -> bool:
        """Decode the plain bitmaps of a group; whether it has files of other names."""
        files = listed("binaryFile", groups[number])
        bitmaps = files.where(named).select(file, "content").coalesce(tasks).mapInArrow(decode_bitmaps, schema)
        bitmaps.withColumn("group", F.lit(number)).write.parquet(f"{kept}/{number}")
        return not files.where(~named).isEmpty()

    with ThreadPoolExecutor(LISTINGS) as pool:
        mixed = [number for number, others in enumerate(pool.map(inheritable_thread_target(spark)(keep), range(len(groups)))) if others]
    bitmaps = spark.read.schema(T.StructType([*schema, T.StructField("group", T.IntegerType())])).parquet(*(f"{kept}/{number}" for number in range(len(groups))))
    odd = bitmaps.where("data is null")
    torn = [row["group"] for row in odd.select("group").distinct().collect()]
    # The image source writes an empty host as //.
    origin = F.regexp_replace("file", "^([a-z0-9]+):/(?!/)", "$1:///").alias("origin")
    images = bitmaps.where("data is not null").select(F.struct(origin, *IMAGE_PARTS.names).alias("image"))
    folders = lambda numbers: [f for number in numbers for f in groups[number]]
    if mixed:
        images = images.unionByName(listed("image", folders(mixed)).where(~named).select("image"))
    if torn:
        left = listed("image", folders(torn)).where(named).select("image", file)
        images = images.unionByName(left.join(odd.select("file"), "file", "left_semi").select("image"))
    return images


def read_labelled_files(spark: SparkSession, path: str, labels: DataFrame, pattern: str, glob: str | None = None) -> DataFrame:
    """Image files with the class of the key found in their path: (path, key, class, image).

    ``labels`` is (key, class); files whose key has no class are left out. Files
    that do not decode stay, with no channels: see ``undecoded``.
    """
    files = read_images(spark, path, glob).select(F.col("image.origin").alias("path"), "image")
    return label_files(files.withColumn("key", F.regexp_extract("path", pattern, 1)), labels, "key")


def undecoded(df: DataFrame) -> DataFrame:
    """Files of the image source that did not decode, to be counted or listed."""
    return df.where(F.col("image.nChannels") <= 0)


def decoded_pixels(df: DataFrame) -> DataFrame:
    """Bytes of the image source (blue, green, red order) as our pixel array in red, green, blue order.

    ``image`` gives way to ``width``, ``height``, ``n_channels`` and ``pixels``, so
    that images of mixed size can go through ``resize_each``. Files that did not
    decode have null pixels.
    """
    keep = [f.name for f in df.schema if f.name not in ("image", "width", "height", "n_channels", "pixels")]
    sizes = [F.col(f"image.{c}").alias(n) for c, n in (("width", "width"), ("height", "height"), ("nChannels", "n_channels"))]
    source = df.select(*keep, *sizes, F.col("image.data").alias("data"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("pixels", VECTOR)])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks: list[np.ndarray | None] = []
            for data, channels in zip(batch.column("data").to_pylist(), batch.column("n_channels").to_pylist(), strict=True):
                if not channels or channels < 0:
                    blocks.append(None)
                    continue
                values = np.frombuffer(data, np.uint8).reshape(-1, channels)
                if channels >= 3:
                    values = np.concatenate([values[:, 2::-1], values[:, 3:]], axis=1)
                blocks.append(values.reshape(-1).astype(np.float64))
            sizes = [0 if x is None else len(x) for x in blocks]
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            flat = np.concatenate([np.empty(0), *(x for x in blocks if x is not None)])
            mask = pa.array([x is None for x in blocks], pa.bool_())
            pixels = pa.ListArray.from_arrays(offsets, pa.array(flat), mask=mask)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pixels], names=schema.names)

    return source.mapInArrow(decode, schema)


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files (not directories) below a path: (path, length); contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Score lines ``id,label,w0,w1,...`` as (row_id, label, scores)."""
    parts = F.split(F.regexp_replace("value", "[()]", ""), ",")
    return spark.read.text(path).filter(F.length("value") > 0).select(
        F.element_at(parts, 1).cast("double").cast("bigint").alias("row_id"),
        F.element_at(parts, 2).cast("double").cast("int").alias("label"),
        F.transform(F.slice(parts, 3, F.size(parts) - 2), lambda p: F.trim(p).cast("double")).alias("scores"),
    )


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``key class`` as (key, class)."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.length(F.trim("value")) > 0).select(
        F.element_at(parts, 1).alias("key"), F.element_at(parts, 2).cast("int").alias("class")
    )


DATASET_FIELDS = T.StructType(
    [
        T.StructField("data", VECTOR),
        T.StructField("label", T.IntegerType()),
        T.StructField("label_weights", VECTOR),
        T.StructField("name", T.StringType()),
    ]
)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Stored dataset records (data, label, label_weights, name)."""
    return spark.read.schema(DATASET_FIELDS).parquet(path)


def read_matrix_lines(spark: SparkSession, path: str) -> np.ndarray:
    """A model matrix from CSV lines, in line order; one that is too large for the driver is an error."""
    rows = numbered_lines(spark, path).select("line_no", parsed_numbers(F.col("value")).alias("row"))
    size = rows.agg(F.sum(F.size("row")).alias("values"), F.count("*").alias("n")).first()
    if (size["values"] or 0) > MODEL_VALUES:
        raise ValueError(f"{size['n']} lines with {size['values']} values are too many for a model matrix on the driver")
    table = rows.toPandas().sort_values("line_no")
    return np.stack(table["row"])
