"""Uncompressed sound files (RIFF .wav) as a Spark data source: mono samples, a chunk a row, chunks read in parallel.

resampled() of operators.audio brings them to another rate.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from glimmer.operators.audio import CHUNKS
from glimmer.operators.series import KEY
from glimmer.sources.video import listed, opened

PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
#: Sample types by format and bits: NumPy's name, the value of silence, and the loudest value.
TYPES = {(PCM, 8): ("u1", 128, 128), (PCM, 16): ("<i2", 0, 1 << 15), (PCM, 32): ("<i4", 0, 1 << 31), (FLOAT, 32): ("<f4", 0, 1), (FLOAT, 64): ("<f8", 0, 1)}


@dataclass(frozen=True)
class Layout:
    kind: tuple[int, int]
    channels: int
    rate: int
    start: int
    frames: int

    @property
    def frame_bytes(self) -> int:
        return self.channels * self.kind[1] // 8


def parse_layout(read_at, size: int) -> Layout:
    """Where the samples of a file lie; read_at(n, position) reads it. A file that isn't such a one is an error."""
    if read_at(12, 0)[:4] != b"RIFF" or read_at(12, 0)[8:] != b"WAVE":
        raise ValueError("no RIFF WAVE header")
    at, form = 12, None
    while at + 8 <= size:
        name, length = struct.unpack("<4sI", read_at(8, at))
        if name == b"fmt ":
            raw = read_at(min(length, 40), at + 8)
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", raw[:16])
            form = (struct.unpack("<H", raw[24:26])[0] if code == EXTENSIBLE else code, bits), channels, rate
        if name == b"data" and form:
            if form[0] not in TYPES or form[1] < 1 or form[2] < 1:
                raise ValueError(f"samples of format and bits {form[0]} can't be read")
            held = min(length, size - at - 8)  # a recording that was cut off names more than there is
            return Layout(*form, at + 8, held // (form[1] * form[0][1] // 8))
        at += 8 + length + length % 2
    raise ValueError("no samples in the file")


def mono(raw: bytes, layout: Layout) -> np.ndarray:
    """The mean of all channels, from -1 to 1."""
    kind, silence, top = TYPES[layout.kind]
    return ((np.frombuffer(raw, kind).astype(float) - silence) / top).reshape(-1, layout.channels).mean(axis=1)


@dataclass
class Stretch(InputPartition):
    path: str
    name: str
    layout: Layout
    chunk: int


class SoundReader(DataSourceReader):
    def __init__(self, path: str, chunk: int):
        self.path, self.chunk = path, chunk

    def partitions(self) -> list[Stretch]:
        out = []
        for path, name, size in listed(self.path, ".wav"):
            with opened(self.path)[0].open_input_file(path) as file:
                layout = parse_layout(file.read_at, size)
            out += [Stretch(path, name, layout, k) for k in range(-(-layout.frames // self.chunk))]
        return out or [Stretch("", "", Layout((PCM, 8), 1, 1, 0, 0), 0)]

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        first, layout = part.chunk * self.chunk, part.layout
        n = min(self.chunk, layout.frames - first)
        if n > 0:
            with opened(self.path)[0].open_input_file(part.path) as file:
                samples = mono(file.read_at(n * layout.frame_bytes, layout.start + first * layout.frame_bytes), layout)
            yield pa.RecordBatch.from_arrays([pa.array([part.name]), pa.array([part.chunk], pa.int64()), pa.array([first], pa.int64()), pa.array([layout.rate], pa.int32()), pa.array([samples], pa.list_(pa.float64()))], names=[KEY, "chunk", "start", "rate", "samples"])


class SoundSource(DataSource):
    """spark.read.format("wav"): chunks of samples of a .wav file, or of all below a folder."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return CHUNKS

    def reader(self, schema: StructType) -> SoundReader:
        return SoundReader(self.options["path"], int(self.options.get("chunk", 1 << 18)))


def samples(spark: SparkSession, path: str, chunk: int = 1 << 18) -> DataFrame:
    """(video_id, chunk, start, rate, samples) of .wav files: mono samples from -1 to 1, `chunk` of them a row; video_id is the file's name.

    A file without samples gives no rows; a missing path and a file that isn't of this kind are errors.
    """
    spark.dataSource.register(SoundSource)
    return spark.read.format("wav").option("chunk", chunk).load(path)
