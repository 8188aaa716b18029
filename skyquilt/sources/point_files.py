"""Point files: LAS as a Spark data source, NPY and text tables."""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from skyquilt.functions.colour import las_channel, unit_channel

# Of the LAS point formats with 16-bit colour, where it stands.
COLOUR_AT = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30}
LAS_SCHEMA = "tile string, idx long, x double, y double, z double, red int, green int, blue int, label short"
# Colours of the classes 0 to 5, for coloured clouds.
PALETTE = {0: (255, 255, 255), 1: (220, 60, 60), 2: (90, 90, 90), 3: (60, 180, 60), 4: (185, 140, 90), 5: (235, 200, 40)}
FULL = 65535.0  # of a 16-bit channel


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, inner


def _files(path: str, suffixes: tuple[str, ...]) -> list[str]:
    from pyarrow import fs

    system, inner = _open(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [path]
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    found = system.get_file_info(fs.FileSelector(inner, recursive=False))
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith(suffixes) and not f.base_name.startswith("."))


def las_header(data: bytes) -> dict:
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    offset, = struct.unpack_from("<I", data, 96)
    form, length, points = struct.unpack_from("<BHI", data, 104)
    if data[25] >= 4 and len(data) >= 255:
        points = struct.unpack_from("<Q", data, 247)[0] or points
    if form & 0x80:
        raise ValueError("compressed LAS is not supported")
    box = struct.unpack_from("<6d", data, 179)
    return {"offset": offset, "format": form & 0x3F, "length": length, "points": points, "scale": struct.unpack_from("<3d", data, 131), "shift": struct.unpack_from("<3d", data, 155), "max": box[::2], "min": box[1::2]}


class LasRange(InputPartition):
    def __init__(self, path: str, header: dict, begin: int, end: int):
        self.path, self.header, self.begin, self.end = path, header, begin, end


class LasReader(DataSourceReader):
    """A task for each range of records; with ``bbox`` (x0,y0,x1,y1), files whose header lies outside are skipped."""

    def __init__(self, options):
        self.path, self.per_task = options["path"], int(options.get("recordspertask", 4_000_000))
        self.bbox = [float(v) for v in options["bbox"].split(",")] if options.get("bbox") else None

    def partitions(self):
        out = []
        for path in _files(self.path, (".las",)):
            system, inner = _open(path)
            with system.open_input_file(inner) as f:
                header = las_header(f.read(375))
            if self.bbox and (header["max"][0] < self.bbox[0] or header["min"][0] > self.bbox[2] or header["max"][1] < self.bbox[1] or header["min"][1] > self.bbox[3]):
                continue
            out += [LasRange(path, header, b, min(b + self.per_task, header["points"])) for b in range(0, header["points"], self.per_task)]
        return out or [LasRange("", {}, 0, 0)]

    def read(self, part) -> Iterator[pa.RecordBatch]:
        if part.begin == part.end:
            return
        h, (system, inner) = part.header, _open(part.path)
        fields = [("p", "<i4", 3, 0), ("c", "u1", 1, 16 if h["format"] >= 6 else 15)]
        if h["format"] in COLOUR_AT:
            fields.append(("k", "<u2", 3, COLOUR_AT[h["format"]]))
        kind = np.dtype({"names": [f[0] for f in fields], "formats": [(f[1], (f[2],)) for f in fields], "offsets": [f[3] for f in fields], "itemsize": h["length"]})
        with system.open_input_file(inner) as f:
            for begin in range(part.begin, part.end, 200_000):
                end = min(begin + 200_000, part.end)
                f.seek(h["offset"] + begin * h["length"])
                rec = np.frombuffer(f.read((end - begin) * h["length"]), dtype=kind)
                xyz = rec["p"] * np.array(h["scale"]) + np.array(h["shift"])
                # extended formats have whole class bytes, the older ones flags in the upper bits
                label = rec["c"][:, 0] if h["format"] >= 6 else rec["c"][:, 0] & 31
                none = pa.nulls(len(rec), pa.int32())
                colour = [pa.array(rec["k"][:, i].astype(np.int32)) for i in range(3)] if "k" in kind.names else [none] * 3
                columns = [pa.array([part.path.rsplit("/", 1)[-1]] * len(rec)), pa.array(np.arange(begin, end)), *[pa.array(xyz[:, i]) for i in range(3)], *colour, pa.array(label.astype(np.int16))]
                yield pa.RecordBatch.from_arrays(columns, names=["tile", "idx", "x", "y", "z", "red", "green", "blue", "label"])


class LasFile(WriterCommitMessage):
    def __init__(self, path: str | None):
        self.path = path


class LasWriter(DataSourceArrowWriter):
    """A LAS 1.2 file, point format 2, for each partition.

    Options ``scale`` and ``offset`` (x,y,z): as given, else 0.001 and the whole
    metres below the first batch.  Files have names of their own, so appending
    adds to what is there; they are written under a hidden name and published when
    the job commits, so retried and failed tasks leave nothing.  Records go to
    the file batch by batch; only the header is written again at the end.
    """

    def __init__(self, options, overwrite: bool):
        self.path, self.scale, self.overwrite = options["path"].rstrip("/"), float(options.get("scale", 0.001)), overwrite
        self.offset = [float(v) for v in options["offset"].split(",")] if options.get("offset") else None
        self.job = uuid.uuid4().hex[:12]

    def write(self, batches):
        from pyspark import TaskContext

        system, inner = _open(self.path)
        system.create_dir(inner, recursive=True)
        task = TaskContext.get()
        hidden = f"{inner}/.{self.job}-{task.partitionId():05d}-{task.taskAttemptId()}"
        n, low, high, shift = 0, None, None, None if self.offset is None else np.array(self.offset)
        kind = np.dtype([("p", "<i4", 3), ("i", "<u2"), ("f", "u1"), ("c", "u1"), ("a", "i1"), ("u", "u1"), ("s", "<u2"), ("k", "<u2", 3)])
        with system.open_output_stream(hidden) as f:
            for batch in batches:
                t = batch.to_pandas()
                if not len(t):
                    continue
                xyz = t[["x", "y", "z"]].to_numpy(dtype=float)
                shift = np.floor(xyz.min(axis=0)) if shift is None else shift
                steps = np.round((xyz - shift) / self.scale)
                if not (np.abs(steps) < 2**31).all():
                    raise ValueError("coordinates are missing or too far apart for this scale and offset")
                rec = np.zeros(len(t), dtype=kind)
                rec["p"] = steps.astype(np.int32)
                rec["c"] = t["label"].fillna(0).to_numpy(dtype=np.uint8)
                rec["k"] = t[["red", "green", "blue"]].fillna(0).to_numpy(dtype=np.uint16)
                f.write(rec.tobytes())
                n += len(t)
                low = xyz.min(axis=0) if low is None else np.minimum(low, xyz.min(axis=0))
                high = xyz.max(axis=0) if high is None else np.maximum(high, xyz.max(axis=0))
        if not n:
            system.delete_file(hidden)
            return LasFile(None)
        head = bytearray(227)
        head[:4], head[24:26] = b"LASF", bytes((1, 2))
        struct.pack_into("<HII", head, 94, 227, 227, 0)
        struct.pack_into("<BHI5I", head, 104, 2, kind.itemsize, n, n, 0, 0, 0, 0)
        struct.pack_into("<3d3d", head, 131, *[self.scale] * 3, *shift)
        struct.pack_into("<6d", head, 179, *[v for a in range(3) for v in (high[a], low[a])])
        whole = f"{hidden}.las"
        with system.open_output_stream(whole) as f, system.open_input_stream(hidden) as body:  # stores have no writing at a place
            f.write(bytes(head))
            while some := body.read(8 << 20):
                f.write(some)
        system.delete_file(hidden)
        return LasFile(whole)

    def commit(self, messages):
        system, inner = _open(self.path)
        system.create_dir(inner, recursive=True)
        if self.overwrite:
            for path in _files(self.path, (".las",)):
                old = _open(path)[1]
                if not old.rsplit("/", 1)[-1].startswith("."):
                    system.delete_file(old)
        for k, m in enumerate(m for m in messages if m and m.path):
            system.move(m.path, f"{inner}/part-{k:05d}-{self.job}.las")
        self._clear()

    def abort(self, messages):
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, inner = _open(self.path)
        for f in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
            if f.base_name.startswith(f".{self.job}-"):
                system.delete_file(f.path)


class LasTileWriter(LasWriter):
    """A file for each tile, with the header of the source's file of that name.

    Options ``like`` (the folder of the sources, or one file for all) and
    ``suffix`` of the new names.  Version, point format, record length, scale,
    offset and variable-length records are the source's; the counts and the box
    are those of the points.  Rows come by tile and in order; hidden files are
    published when the job commits.
    """

    def __init__(self, options, overwrite: bool):
        super().__init__(options, overwrite)
        self.like, self.suffix = options["like"].rstrip("/"), options.get("suffix", "")

    def _source(self, tile: str) -> bytes:
        from pyarrow import fs

        system, inner = _open(self.like)
        path = inner if system.get_file_info(inner).type == fs.FileType.File else f"{inner}/{tile}"
        with system.open_input_file(path) as f:
            head = f.read(375)
            return head + f.read(max(0, las_header(head)["offset"] - 375))

    def _records(self, table, head: dict) -> np.ndarray:
        form, length = head["format"], head["length"]
        fields = [("p", "<i4", (3,), 0), ("c", "u1", (), 16 if form >= 6 else 15)] + ([("k", "<u2", (3,), COLOUR_AT[form])] if form in COLOUR_AT else [])
        rec = np.zeros(len(table), dtype=np.dtype({"names": [f[0] for f in fields], "formats": [(f[1], f[2]) for f in fields], "offsets": [f[3] for f in fields], "itemsize": length}))
        steps = np.round((table[["x", "y", "z"]].to_numpy(dtype=float) - np.array(head["shift"])) / np.array(head["scale"]))
        if not (np.abs(steps) < 2**31).all():
            raise ValueError("coordinates are missing or too far apart for this scale and offset")
        rec["p"], rec["c"] = steps.astype(np.int32), table["label"].fillna(0).to_numpy(dtype=np.uint8)
        if form in COLOUR_AT:
            rec["k"] = table[["red", "green", "blue"]].fillna(0).to_numpy(dtype=np.uint16)
        return rec

    def _header(self, source: bytes, n: int, low: np.ndarray, high: np.ndarray) -> bytes:
        head = las_header(source)
        out = bytearray(source[: head["offset"]])
        few = n if head["format"] < 6 and n < 2**32 else 0
        struct.pack_into("<I5I", out, 107, few, few, 0, 0, 0, 0)
        struct.pack_into("<6d", out, 179, *[v for a in range(3) for v in (high[a], low[a])])
        size = struct.unpack_from("<H", out, 94)[0]
        if size >= 235:  # no waveforms
            struct.pack_into("<Q", out, 227, 0)
        if size >= 375:  # no records behind the points; counts of 64 bits
            struct.pack_into("<QI", out, 235, 0, 0)
            struct.pack_into("<16Q", out, 247, n, n, *[0] * 14)
        return bytes(out)

    def write(self, batches):
        from pyspark import TaskContext

        system, inner = _open(self.path)
        system.create_dir(inner, recursive=True)
        task, files, at = TaskContext.get(), [], None
        hidden = f"{inner}/.{self.job}-{task.partitionId():05d}-{task.taskAttemptId()}"

        def close() -> None:
            tile, source, body, n, low, high = at
            body.close()
            whole = f"{hidden}-{len(files)}.las"
            with system.open_output_stream(whole) as f, system.open_input_stream(hidden) as points:
                f.write(self._header(source, n, low, high))
                while some := points.read(8 << 20):
                    f.write(some)
            system.delete_file(hidden)
            files.append((whole, tile))

        for batch in batches:
            for tile, table in batch.to_pandas().groupby("tile", sort=False):
                if at is not None and at[0] != tile:
                    close()
                    at = None
                if at is None:
                    at = [tile, self._source(tile), system.open_output_stream(hidden), 0, np.full(3, np.inf), np.full(3, -np.inf)]
                xyz = table[["x", "y", "z"]].to_numpy(dtype=float)
                at[2].write(self._records(table, las_header(at[1])).tobytes())
                at[3:] = at[3] + len(table), np.minimum(at[4], xyz.min(axis=0)), np.maximum(at[5], xyz.max(axis=0))
        if at is not None:
            close()
        return LasFile(files or None)

    def commit(self, messages):
        system, inner = _open(self.path)
        system.create_dir(inner, recursive=True)
        files = [f for m in messages if m and m.path for f in m.path]
        if self.overwrite:
            for path in _files(self.path, (".las",)):
                system.delete_file(_open(path)[1])
        for hidden, tile in files:
            system.move(hidden, f"{inner}/{tile.removesuffix('.las')}{self.suffix}.las")
        self._clear()


class LasSource(DataSource):
    """``spark.read.format('las')``; needs ``spark.dataSource.register(LasSource)``."""

    @classmethod
    def name(cls):
        return "las"

    def schema(self):
        return LAS_SCHEMA

    def reader(self, schema):
        return LasReader(self.options)

    def writer(self, schema, overwrite):
        return (LasTileWriter if self.options.get("like") else LasWriter)(self.options, overwrite)


def read_las(spark: SparkSession, path: str, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    spark.dataSource.register(LasSource)
    reader = spark.read.format("las")
    if bbox:
        reader = reader.option("bbox", ",".join(map(str, bbox)))
    return reader.load(path)


def write_las(points: DataFrame, path: str, mode: str = "append", scale: float = 0.001, offset: tuple[float, float, float] | None = None) -> None:
    points.sparkSession.dataSource.register(LasSource)
    writer = points.select("x", "y", "z", "red", "green", "blue", "label").write.format("las").option("scale", scale)
    if offset:
        writer = writer.option("offset", ",".join(map(str, offset)))
    writer.mode(mode).save(path)


def write_las_tiles(points: DataFrame, path: str, like: str, suffix: str = "", mode: str = "append") -> None:
    """A file for each ``tile`` with its points in order of ``idx``, and the header of the file of that name in ``like`` (see ``LasTileWriter``).

    A tile is written by one task, batch by batch, as its points stand in one file.
    """
    points.sparkSession.dataSource.register(LasSource)
    dealt = points.select("tile", "idx", "x", "y", "z", "red", "green", "blue", "label").repartition("tile").sortWithinPartitions("tile", "idx")
    dealt.write.format("las").option("like", like).option("suffix", suffix).mode(mode).save(path)


def tile_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``tile, points, format, bytes`` and the box of each LAS file, from headers alone: a task reads the headers of some files."""
    files = spark.createDataFrame([(p,) for p in _files(path, (".las",))], "path string")

    def read(frames):
        for frame in frames:
            rows = []
            for p in frame["path"]:
                system, inner = _open(p)
                with system.open_input_file(inner) as f:
                    h = las_header(f.read(375))
                rows.append((p.rsplit("/", 1)[-1], h["points"], *h["min"], *h["max"], h["format"], system.get_file_info(inner).size))
            yield pd.DataFrame(rows, columns=["tile", "points", "minx", "miny", "minz", "maxx", "maxy", "maxz", "format", "bytes"])

    return files.repartition(max(1, min(files.count(), spark.sparkContext.defaultParallelism))).mapInPandas(read, "tile string, points long, minx double, miny double, minz double, maxx double, maxy double, maxz double, format int, bytes long")


def las_cloud(points: DataFrame, unit: bool = False) -> DataFrame:
    """Records of ``read_las`` with r, g, b for the operators.

    As for training: 0 to 255, where a file's channels are divided by 257 if the
    largest is above 255.  With ``unit``, as for classifying: 0 to 1, channels
    divided by 65535 whatever they hold.
    """
    channels = dict(zip("rgb", ("red", "green", "blue"), strict=True))
    if unit:
        return points.withColumns({c: unit_channel(F.col(k), FULL) for c, k in channels.items()})
    top = points.groupBy("tile").agg(F.max(F.greatest("red", "green", "blue")).alias("_top"))
    return points.join(F.broadcast(top), "tile").withColumns({c: las_channel(F.col(k), F.col("_top")) for c, k in channels.items()}).drop("_top")


def las_records(points: DataFrame, column: str = "class", coloured: bool = False) -> DataFrame:
    """Classified points, colour 0 to 1, as LAS records: the class as label, and their own colour at 16 bits or the palette's."""
    def channel(i: int) -> Column:
        own = F.col("rgb"[i])
        if coloured:
            own = F.coalesce(F.get(F.array(*[F.lit(PALETTE[k][i]) for k in sorted(PALETTE)]), F.col(column)), F.lit(0)) / 255.0
        return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(FULL), own * FULL))).cast("int")

    return points.withColumns({c: channel(i) for i, c in enumerate(("red", "green", "blue"))}).withColumn("label", F.col(column).cast("short"))


def _named(rows: DataFrame) -> DataFrame:
    """Point columns from an array of numbers, by its length: 3 xyz, 4 with label, 6 with colour, 7 with both."""
    v, n = F.col("v"), F.size("v")
    at = lambda i: F.get(v, F.lit(i))
    shade = lambda i: F.when(n >= 6, F.greatest(F.lit(0.0), F.least(F.lit(255.0), at(i))))
    label = F.when(n == 4, at(3)).when(n >= 7, at(6)).cast("int")
    return rows.select("scene", "idx", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), shade(3).alias("r"), shade(4).alias("g"), shade(5).alias("b"), label.alias("label"))


def read_text_points(spark: SparkSession, path: str) -> DataFrame:
    """Numbers between white space, a point a line; empty lines are skipped, other text is an error."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("scene"), F.monotonically_increasing_id().alias("idx"), F.trim("value").alias("value")).where("value <> ''")
    return _named(lines.select("scene", "idx", F.split("value", r"\s+").cast("array<double>").alias("v")))


def read_npy_points(spark: SparkSession, path: str) -> DataFrame:
    """Two-dimensional ``.npy`` tables, one scene a file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)

    def rows(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                table = np.load(io.BytesIO(content), allow_pickle=False).astype(float)
                for at in range(0, len(table), 50_000):
                    some = table[at : at + 50_000]
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, some.size + 1, some.shape[1], dtype=np.int32)), pa.array(some.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(some)), pa.array(np.arange(at, at + len(some))), flat], names=["scene", "idx", "v"])

    return _named(files.select("path", "content").mapInArrow(rows, "scene string, idx long, v array<double>"))


def read_split(spark: SparkSession, folder: str, split: str, read=read_npy_points) -> DataFrame:
    """The clouds of ``folder/split``, or of ``folder`` where there is no such split."""
    from pyarrow import fs

    system, inner = _open(folder)
    there = system.get_file_info(f"{inner.rstrip('/')}/{split}").type == fs.FileType.Directory
    return read(spark, f"{folder.rstrip('/')}/{split}" if there else folder)


def write_blocks(blocked: DataFrame, path: str) -> None:
    """Points by split and block."""
    blocked.write.mode("overwrite").partitionBy("split", "file").parquet(path)
