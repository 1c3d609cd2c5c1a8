"""Uncompressed video files (YUV4MPEG2, .y4m) as a Spark data source, and back.

A file has a header line and frames of one length, so any frame can be read without those before it: a file is cut into
segments of frames. A partition is a segment, or as many small ones, of one or of many files, as make up TASK_BYTES; the
headers of small files are read in tasks. Frames that sampling leaves out are never read, unless they are so small that
they lie within a page. What is pushed into the scan: comparisons of frame_index and video_id (as Spark filters), sampling
(option step) and pixels (option pixels=false leaves them on disk). Paths may lie in any file system that Arrow opens.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import nullcontext
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from glimmer.operators.frames import FRAME
from glimmer.operators.series import KEY

MAGIC, MARK = b"YUV4MPEG2", b"FRAME"
#: Bytes of a file in which its header line has to end, and of frames in a batch.
HEADER_BYTES, BATCH_BYTES = 4096, 1 << 24
#: Small segments make up a task until they have so many bytes or lie in so many files; a scan has about TASKS of them, if it can, before they get there.
TASK_BYTES, TASK_FILES, TASKS = 1 << 24, 512, 64
#: Frames that are so many bytes apart at most are read with what lies between them.
PAGE_BYTES = 4096
#: Samples of each chroma plane for one pixel, by colour space; 420 has several spellings.
CHROMA = {"mono": 0.0, "444": 1.0, "420": 0.25}


@dataclass(frozen=True)
class Header:
    width: int
    height: int
    fps: float
    colours: str
    length: int
    """Bytes before the first frame."""

    @property
    def frame_bytes(self) -> int:
        if self.colours == "420":
            return self.width * self.height + 2 * ((self.width + 1) // 2) * ((self.height + 1) // 2)
        return int(self.width * self.height * (1 + 2 * CHROMA[self.colours]))

    @property
    def stride(self) -> int:
        return len(MARK) + 1 + self.frame_bytes

    def frames(self, size: int) -> int:
        """Of a file of so many bytes; a frame that is cut off isn't one."""
        return max(0, size - self.length) // self.stride


def parse_header(raw: bytes) -> Header:
    """The header line of a file; one that isn't such a file is an error. A rate that isn't positive is 0."""
    line, _, rest = raw.partition(b"\n")
    fields = line.decode("ascii", "replace").split(" ")
    if fields[0].encode() != MAGIC or len(line) == len(raw):
        raise ValueError("no YUV4MPEG2 header")
    given = {f[0]: f[1:] for f in fields[1:] if f}
    above, _, below = given.get("F", "0:1").partition(":")
    fps = int(above) / int(below) if int(below or 0) > 0 else 0.0
    colours = given.get("C", "420")
    colours = "420" if colours.startswith("420") and not colours.startswith("420p") else colours
    if colours not in CHROMA or int(given["W"]) <= 0 or int(given["H"]) <= 0:
        raise ValueError(f"frames of {colours} can't be read")
    if rest and not rest.startswith(MARK + b"\n"):
        raise ValueError("frames with parameters of their own can't be read")
    return Header(int(given["W"]), int(given["H"]), fps, colours, len(line) + 1)


def to_bgr(planes: np.ndarray, header: Header) -> np.ndarray:
    """Frames (n, bytes of a frame) as (n, height, width, 3), by BT.601 with the usual footroom; mono is grey as it is."""
    n, h, w = len(planes), header.height, header.width
    luma = planes[:, : h * w].reshape(n, h, w)
    if header.colours == "mono":
        return np.repeat(luma[..., None], 3, axis=3)
    if header.colours == "444":
        cb, cr = (planes[:, k * h * w : (k + 1) * h * w].reshape(n, h, w) for k in (1, 2))
    else:
        half = ((h + 1) // 2, (w + 1) // 2)
        size = half[0] * half[1]
        cb, cr = (planes[:, h * w + k * size : h * w + (k + 1) * size].reshape(n, *half).repeat(2, axis=1).repeat(2, axis=2)[:, :h, :w] for k in (0, 1))
    y, u, v = 1.164 * (luma.astype(float) - 16), cb.astype(float) - 128, cr.astype(float) - 128
    return np.clip(np.rint(np.stack((y + 2.018 * u, y - 0.391 * u - 0.813 * v, y + 1.596 * v), axis=-1)), 0, 255).astype(np.uint8)


def listed(path: str, suffix: str) -> list[tuple[str, str, int]]:
    """(Arrow path, name, bytes) of a file, or of all files below a folder with this suffix."""
    files, root = opened(path)
    info = files.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else [x for x in files.get_file_info(pafs.FileSelector(root, recursive=True)) if x.type == pafs.FileType.File and x.path.endswith(suffix)]
    return sorted((x.path, x.base_name, x.size) for x in found)


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else pafs.FileSystem.from_uri(f"file://{path.removeprefix('file:')}")


@dataclass
class Segment:
    path: str
    name: str
    size: int
    header: Header | None
    """None: it is read in the task."""
    first: int
    end: int | None
    """None: the last frame of the file is the last one."""


@dataclass
class Segments(InputPartition):
    parts: list[Segment]

    @property
    def first(self) -> int:
        return self.parts[0].first

    @property
    def end(self) -> int | None:
        return self.parts[-1].end


@dataclass
class Bounds:
    """Comparisons of one number column that a scan takes over."""

    low: int | None = None
    high: int | None = None

    def take(self, f: Filter) -> bool:
        value = getattr(f, "value", None)
        if not isinstance(value, int) or isinstance(value, bool):
            return False
        if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
            self.low = max(x for x in (self.low, value + isinstance(f, GreaterThan)) if x is not None)
        if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
            self.high = min(x for x in (self.high, value - isinstance(f, LessThan)) if x is not None)
        return isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, EqualTo))


class FrameReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.schema = options["path"], schema
        self.step, self.segment = max(1, int(options.get("step", 1))), max(1, int(options.get("segment", 512)))
        self.index, self.names = Bounds(), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if isinstance(f, IsNotNull) or column == ("frame_index",) and self.index.take(f):
                continue  # no column is ever null
            if column == (KEY,) and isinstance(f, (EqualTo, In)):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = named if self.names is None else self.names & named
                continue
            yield f

    def partitions(self) -> list[Segments]:
        found = [x for x in listed(self.path, ".y4m") if self.names is None or x[1] in self.names]
        most = min(TASK_BYTES, sum(size for _, _, size in found) // TASKS)
        most_files = min(TASK_FILES, max(1, len(found) // TASKS))
        low, high = max(0, self.index.low or 0), None if self.index.high is None else self.index.high + 1
        out, held, files = [], 0, 0
        for path, name, size in found:
            if size <= most:
                cut = [(Segment(path, name, size, None, low, high), size)]
            else:
                with opened(self.path)[0].open_input_file(path) as file:
                    header = parse_header(file.read(HEADER_BYTES))
                end = header.frames(size) if high is None else min(header.frames(size), high)
                cut = [(Segment(path, name, size, header, k, min(k + self.segment, end)), header.stride * min(self.segment, end - k)) for k in range(low, end, self.segment)]
            for k, (part, size_of) in enumerate(cut):
                if not out or held + size_of > most or k == 0 and files == most_files:
                    out.append(Segments([part]))
                    held, files = size_of, 1
                    continue
                held, files, last = held + size_of, files + (k == 0), out[-1].parts[-1]
                if k and last.path == path:
                    last.end = part.end
                else:
                    out[-1].parts.append(part)
        return out or [Segments([])]

    def read(self, part: Segments) -> Iterator[pa.RecordBatch]:
        files, names = opened(self.path)[0], self.schema.names
        held: list[tuple[Segment, Header, np.ndarray, np.ndarray | None]] = []
        rows = size = 0
        for segment in part.parts:
            for header, index, stack in self._stacks(files, segment):
                held.append((segment, header, index, stack))
                rows, size = rows + len(index), size + len(index) * (header.frame_bytes if stack is not None else 0)
                if rows >= 1 << 16 or size >= BATCH_BYTES:
                    yield _batch(held, names)
                    held, rows, size = [], 0, 0
        if held:
            yield _batch(held, names)

    def _stacks(self, files: pafs.FileSystem, part: Segment) -> Iterator[tuple[Header, np.ndarray, np.ndarray | None]]:
        """(header, indexes, frames) of a segment; without frames where pixels aren't asked for."""
        pixels, header = "pixels" in self.schema.names, part.header
        with files.open_input_file(part.path) if pixels or header is None else nullcontext() as file:
            header = header or parse_header(file.read(HEADER_BYTES))
            end = header.frames(part.size) if part.end is None else min(header.frames(part.size), part.end)
            wanted, far = np.arange(part.first + -part.first % self.step, end, self.step), self.step * header.stride
            through = self.step == 1 or far <= PAGE_BYTES
            most = max(1, BATCH_BYTES // (far if through else header.stride)) if pixels else 1 << 16
            for k in range(0, len(wanted), most):
                index = wanted[k : k + most]
                if not pixels:
                    yield header, index, None
                    continue
                at = header.length + index * header.stride
                raw = file.read_at(int(at[-1] - at[0]) + header.stride, int(at[0])) if through else b"".join(file.read_at(header.stride, x) for x in at.tolist())
                planes = np.frombuffer(raw, np.uint8).reshape(-1, header.stride)[:: self.step if through else 1, len(MARK) + 1 :]
                yield header, index, to_bgr(planes, header)


def _batch(held: list[tuple[Segment, Header, np.ndarray, np.ndarray | None]], names: list[str]) -> pa.RecordBatch:
    """The frames of several segments as one batch."""

    def repeated(of: Callable[[Segment, Header], object], kind: pa.DataType) -> pa.Array:
        return pa.array([of(part, header) for part, header, _, _ in held], kind).take(pa.array(np.repeat(np.arange(len(held)), [len(x[2]) for x in held])))

    index = np.concatenate([x[2] for x in held])
    fps = np.concatenate([np.full(len(x[2]), x[1].fps if x[1].fps > 0 else 25.0) for x in held])
    columns = {KEY: repeated(lambda part, _: part.name, pa.string()), "frame_index": pa.array(index, pa.int64()), "time": pa.array(index / fps), "width": repeated(lambda _, header: header.width, pa.int32()), "height": repeated(lambda _, header: header.height, pa.int32())}
    if "pixels" in names:
        columns["pixels"] = pa.concat_arrays([_pixels(x[3]) for x in held])
    return pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)


def _pixels(stack: np.ndarray) -> pa.Array:
    cells = stack[0].size
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(cells), len(stack), [None, pa.py_buffer(np.ascontiguousarray(stack))]).cast(pa.binary())


class FrameSource(DataSource):
    """spark.read.format("y4m"): frames of a .y4m file, or of all below a folder."""

    @classmethod
    def name(cls) -> str:
        return "y4m"

    def schema(self) -> str:
        return FRAME if self.options.get("pixels", "true").lower() == "true" else FRAME.removesuffix(", pixels binary")

    def reader(self, schema: StructType) -> FrameReader:
        return FrameReader(dict(self.options), schema)


def frames(spark: SparkSession, path: str, step: int = 1, segment: int = 512, pixels: bool = True) -> DataFrame:
    """(video_id, frame_index, time, width, height, pixels) of .y4m files; video_id is the file's name.

    Every step-th frame; `segment` frames at most are one task's, unless they are small: then a task takes several segments,
    and whole files. A missing path and a file without such a header are errors; a folder without such files gives no rows.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameSource)
    return spark.read.format("y4m").option("step", step).option("segment", segment).option("pixels", str(pixels).lower()).load(path)


def video_rows(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, fps, frame_count, file_size_bytes) from the headers of .y4m files, for media.video_info()."""
    spark.dataSource.register(HeaderSource)
    return spark.read.format("y4m_headers").load(path)


class HeaderReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        found = listed(self.path, ".y4m")
        return [InputPartition(found[k : k + 1000]) for k in range(0, len(found), 1000)] or [InputPartition([])]

    def read(self, part: InputPartition) -> Iterator[tuple]:
        for path, name, size in part.value:
            with opened(self.path)[0].open_input_file(path) as file:
                header = parse_header(file.read(HEADER_BYTES))
            yield name, header.fps, (size - header.length) // header.stride, size


class HeaderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "y4m_headers"

    def schema(self) -> str:
        return "video_id string, fps double, frame_count long, file_size_bytes long"

    def reader(self, schema: StructType) -> HeaderReader:
        return HeaderReader(self.options["path"])


#: Frames in a row of a video, packed: frames first to first + n - 1, all of one size.
RUN = "video_id string, first long, n int, width int, height int, frames binary"
#: Bytes of frames in a run, and the missing index, which comes before all others.
RUN_BYTES, NO_INDEX = 1 << 20, -(1 << 63)
#: Folders that written files are spread over: tasks that make files in one folder wait for each other.
FOLDERS = 256


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grey frames (video_id, frame_index, width, height, pixels) as RUN; frames whose indexes follow one another as they come share a row."""
    codec = pa.Codec("zstd", compression_level=1)
    for batch in batches:
        if not batch.num_rows:
            continue
        index = batch["frame_index"].fill_null(NO_INDEX).to_numpy()
        codes = batch[KEY].dictionary_encode(null_encoding="encode").indices.to_numpy()
        width, height = batch["width"].to_numpy(), batch["height"].to_numpy()
        follows = index[1:] == index[:-1] + 1
        for x in (codes, width, height):
            follows &= x[1:] == x[:-1]
        starts = np.flatnonzero(np.concatenate(([True], ~follows)))
        cells = np.maximum(1, width[starts].astype(np.int64) * height[starts])
        cut = [np.arange(k, end, max(1, RUN_BYTES // size)) for k, end, size in zip(starts.tolist(), [*starts[1:].tolist(), len(index)], cells.tolist(), strict=True)]
        starts = np.concatenate(cut)
        ends = np.append(starts[1:], len(index))
        _, offsets, data = batch["pixels"].buffers()
        at = np.frombuffer(offsets, np.int32)[batch["pixels"].offset :]
        frames = [codec.compress((data or b"")[int(at[a]) : int(at[b])], asbytes=True) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        rows = pa.array(starts)
        yield pa.RecordBatch.from_arrays([batch[KEY].take(rows), pa.array(index[starts]), pa.array((ends - starts).astype(np.int32)), batch["width"].take(rows), batch["height"].take(rows), pa.array(frames, pa.binary())], names=[KEY, "first", "n", "width", "height", "frames"])


def write_frames(grey: DataFrame, folder: str, fps: int = 25) -> DataFrame:
    """Grey frames (one byte a pixel) as one .y4m file per video below a folder; (video_id, path, n) of what was written.

    Which of FOLDERS folders a file lies in follows from its name. A task writes a video's frames as they come, in order of their indexes, to a file of its own that takes its name
    when it is whole: a repeated task writes the same again. Frames cross the network in packed runs. Nothing is written until the
    result is read.
    """
    used = grey.where(F.octet_length("pixels") == F.col("width") * F.col("height")).select(KEY, F.col("frame_index").cast("long").alias("frame_index"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "pixels")
    dealt = used.mapInArrow(_runs, RUN).repartition(KEY).sortWithinPartitions(KEY, "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(folder)
        video, place, sink, n, size = None, "", None, 0, None
        made: set[str] = set()
        held: list[tuple[int, np.ndarray]] = []  # runs that overlap, as indexes occur twice or runs interleave

        def put() -> None:
            stack = np.concatenate([x for _, x in held])
            if len(held) > 1:
                stack = stack[np.argsort(np.concatenate([first + np.arange(len(x)) for first, x in held]), kind="stable")]
            out = np.empty((len(stack), len(MARK) + 1 + stack.shape[1]), np.uint8)
            out[:, : len(MARK) + 1], out[:, len(MARK) + 1 :] = np.frombuffer(MARK + b"\n", np.uint8), stack
            sink.write(pa.py_buffer(out))
            held.clear()

        def close() -> list[tuple[str, str, int]]:
            if sink is None:
                return []
            put()
            sink.close()
            files.move(f"{root}/{place}.part", f"{root}/{place}")
            return [(video, f"{folder}/{place}", n)]

        for batch in batches:
            done = []
            for name, first, count, width, height, raw in zip(*(batch[c].to_pylist() for c in (KEY, "first", "n", "width", "height", "frames")), strict=True):
                if name != video:
                    done += close()
                    video, n, size, reach = name, 0, (width, height), first
                    within = f"{zlib.crc32(name.encode()) % FOLDERS:02x}"
                    if within not in made:
                        files.create_dir(f"{root}/{within}")
                        made.add(within)
                    place = f"{within}/{video}"
                    sink = files.open_output_stream(f"{root}/{place}.part")
                    sink.write(f"YUV4MPEG2 W{width} H{height} F{fps}:1 Cmono\n".encode())
                if (width, height) != size:
                    raise ValueError(f"frames of {video} differ in size")
                if held and first >= reach:
                    put()
                held.append((first, np.frombuffer(pa.decompress(raw, count * width * height, "zstd"), np.uint8).reshape(count, width * height)))
                n, reach = n + count, max(reach, first + count)
            yield _written(done)
        yield _written(close())

    return dealt.mapInArrow(write, "video_id string, path string, n long")


def _written(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
    name, path, n = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(path, pa.string()), pa.array(n, pa.int64())], names=[KEY, "path", "n"])
