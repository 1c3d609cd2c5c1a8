"""Frames and samples from files of their own formats."""

import struct
import wave
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glimmer.operators import audio, frames
from glimmer.sources import media, sound, video


def y4m(path, stack, head="F25:1 Cmono", tail=b""):
    n, h, w = stack.shape
    path.write_bytes(f"YUV4MPEG2 W{w} H{h} {head}\n".encode() + b"".join(b"FRAME\n" + x.tobytes() for x in stack) + tail)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("videos")
    rng = np.random.default_rng(0)
    stacks = {"a.y4m": rng.integers(0, 256, (23, 6, 8)).astype(np.uint8), "b.y4m": rng.integers(0, 256, (5, 4, 4)).astype(np.uint8)}
    y4m(root / "a.y4m", stacks["a.y4m"], tail=b"FRAME\n" + b"x" * 10)  # the last frame is cut off
    (root / "more").mkdir()
    y4m(root / "more" / "b.y4m", stacks["b.y4m"], "F0:0 Cmono")
    (root / "note.txt").write_text("no video")
    return root, stacks


@pytest.mark.parametrize(("step", "segment"), [(1, 512), (3, 4), (7, 1)])
def test_frames_of_segments(spark, folder, step, segment):
    root, stacks = folder
    got = video.frames(spark, str(root), step, segment).collect()
    want = {(v, k): x[k] for v, x in stacks.items() for k in range(0, len(x), step)}
    assert {(r["video_id"], r["frame_index"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        grey = want[(r["video_id"], r["frame_index"])]
        assert r["time"] == r["frame_index"] / 25 and (r["height"], r["width"]) == grey.shape
        assert np.frombuffer(r["pixels"], np.uint8).reshape(*grey.shape, 3).tolist() == np.repeat(grey[..., None], 3, axis=2).tolist()


def test_what_is_pushed_into_the_scan(spark, folder):
    root, _ = folder
    df = video.frames(spark, str(root), 2, 4, pixels=False).where((F.col("frame_index") >= 9) & (F.col("frame_index") < 17) & (F.col("video_id") == "a.y4m"))
    assert sorted(r["frame_index"] for r in df.collect()) == [10, 12, 14, 16] and "pixels" not in df.columns
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(frame_index,9), LessThan(frame_index,17), EqualTo(video_id,a.y4m)]" in plan and "Filter (" not in plan
    reader = video.FrameReader({"path": str(root), "segment": "4"}, None)
    left = list(reader.pushFilters([video.GreaterThanOrEqual(("frame_index",), 9), video.LessThan(("frame_index",), 17), video.EqualTo(("video_id",), "a.y4m"), video.GreaterThan(("time",), 0.1)]))
    assert len(left) == 1 and [(p.first, p.end) for p in reader.partitions()] == [(9, 13), (13, 17)]


def test_small_segments_share_tasks(spark, tmp_path):
    rng = np.random.default_rng(3)
    stacks = {f"v{k:03}.y4m": rng.integers(0, 256, (1 + k % 9, 2, 3 + k % 2)).astype(np.uint8) for k in range(300)}
    stacks["long.y4m"] = rng.integers(0, 256, (2000, 2, 3)).astype(np.uint8)
    for name, stack in stacks.items():
        y4m(tmp_path / name, stack)
    reader = video.FrameReader({"path": str(tmp_path), "segment": "2"}, None)
    assert 40 < len(reader.partitions()) <= 200  # 1898 segments
    df = video.frames(spark, str(tmp_path), 3, 2).where("frame_index >= 2 and frame_index < 1500")
    assert df.rdd.getNumPartitions() <= 200
    got = {(r["video_id"], r["frame_index"]): (r["time"], r["height"], r["width"], r["pixels"][::3]) for r in df.collect()}
    assert got == {(v, k): (k / 25, *x.shape[1:], x[k].tobytes()) for v, x in stacks.items() for k in range(3, min(1500, len(x)), 3)}
    assert df.count() == len(got) and video.frames(spark, str(tmp_path), 5, 2, pixels=False).count() == sum(-(-len(x) // 5) for x in stacks.values())
    (tmp_path / "w.y4m").write_bytes(b"no video")
    with pytest.raises(Exception, match="header"):
        video.frames(spark, str(tmp_path)).count()


def test_frames_over_a_page_are_read_one_by_one(spark, tmp_path, monkeypatch):
    stack = np.random.default_rng(4).integers(0, 256, (7, 50, 60)).astype(np.uint8)
    y4m(tmp_path / "a.y4m", stack)
    reader = video.FrameReader({"path": str(tmp_path), "step": "2"}, video.StructType.fromDDL(frames.FRAME))
    for most in (video.BATCH_BYTES, 5000):  # batches of all frames, and of one or two
        monkeypatch.setattr(video, "BATCH_BYTES", most)
        rows = [r for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]
        assert [(r["frame_index"], r["pixels"][::3]) for r in rows] == [(k, stack[k].tobytes()) for k in (0, 2, 4, 6)]


def test_headers_and_colours(spark, folder, tmp_path):
    root, _ = folder
    info = {r["video_id"]: r for r in media.video_info(video.video_rows(spark, str(root))).collect()}
    assert (info["a.y4m"]["fps"], info["a.y4m"]["frame_count"], info["a.y4m"]["duration"]) == (25.0, 23, 23 / 25)
    assert info["b.y4m"]["fps"] == 25.0
    header = video.parse_header(b"YUV4MPEG2 W3 H3 F30:1 Ip A1:1 C420jpeg\nFRAME\n")
    assert (header.frame_bytes, header.fps) == (9 + 2 * 4, 30.0)
    planes = np.concatenate((np.full(9, 81), np.full(4, 90), np.full(4, 240))).astype(np.uint8)  # red
    assert np.abs(video.to_bgr(planes[None], header)[0] - np.array([0, 0, 255])).max() <= 2
    full = video.parse_header(b"YUV4MPEG2 W3 H1 F30:1 C444\n")
    assert video.to_bgr(np.array([[16, 235, 126, 128, 128, 128, 128, 128, 128]], np.uint8), full)[0, 0].tolist() == [[0, 0, 0], [255, 255, 255], [128, 128, 128]]
    for raw in (b"RIFF", b"YUV4MPEG2 W3 H1", b"YUV4MPEG2 W3 H1 C410\n", b"YUV4MPEG2 W3 H1 Cmono\nFRAME Ip\n"):
        with pytest.raises(ValueError, match="read|header"):
            video.parse_header(raw)
    with pytest.raises(Exception, match="FileNotFound"):
        video.frames(spark, str(tmp_path / "none")).collect()
    assert video.frames(spark, str(tmp_path)).count() == 0


def test_written_frames_come_back(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"v{v}.y4m", k, k / 25, 5, 4, rng.integers(0, 256, 20).astype(np.uint8).tobytes()) for v in range(3) for k in range(9)]
    grey = spark.createDataFrame(rows, frames.FRAME)
    done = video.write_frames(grey, str(tmp_path)).collect()
    assert sorted((r["video_id"], r["n"]) for r in done) == [(f"v{v}.y4m", 9) for v in range(3)]
    back = video.frames(spark, str(tmp_path), segment=2).collect()
    assert {(r["video_id"], r["frame_index"]): r["pixels"][::3] for r in back} == {r[:2]: r[5] for r in rows}


def test_runs_are_written_in_order_of_their_indexes(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(v, k, 0.0, 5, 4, rng.integers(0, 256, 20).astype(np.uint8).tobytes()) for v, n in (("a.y4m", 40), ("b.y4m", 1)) for k in range(n)]
    rows += [("a.y4m", k, 0.0, 5, 4, bytes([200 + k] * 20)) for k in range(10, 14)]  # indexes that occur twice
    parts = [[rows[k] for k in range(41) if k % 3 == 0], [rows[k] for k in range(41) if k % 3], rows[41:], [("a.y4m", 3, 0.0, 5, 4, b"short"), ("a.y4m", None, 0.0, 5, 4, b"n" * 20)]]
    grey = spark.createDataFrame(parts[0], frames.FRAME)
    for part in parts[1:]:
        grey = grey.unionByName(spark.createDataFrame(part, frames.FRAME))
    done = {r["video_id"]: r for r in video.write_frames(grey, str(tmp_path)).collect()}
    assert {v: r["n"] for v, r in done.items()} == {"a.y4m": 45, "b.y4m": 1}
    assert {Path(r["path"]).parent.parent for r in done.values()} == {tmp_path} and len({Path(r["path"]).parent for r in done.values()}) == 2  # spread over folders
    raw = Path(done["a.y4m"]["path"]).read_bytes()
    got = [raw[k + 6 : k + 26] for k in range(raw.index(b"FRAME"), len(raw), 26)]
    index = sorted([-1, *range(40), *range(10, 14)])
    assert len(got) == 45 and got[0] == b"n" * 20
    for k in range(-1, 40):
        assert {x for i, x in zip(index, got, strict=True) if i == k} == ({b"n" * 20} if k < 0 else {r[5] for r in rows if r[:2] == ("a.y4m", k)})


def test_frames_cross_the_network_packed(monkeypatch):
    rows = [("a.y4m", k, 5, 4, b"x" * 20) for k in range(100)] + [("a.y4m", 101, 5, 4, b"y" * 20), ("b.y4m", 102, 5, 4, b"z" * 20), ("b.y4m", 103, 4, 5, b"z" * 20)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("video_id", "frame_index", "width", "height", "pixels"), r, strict=True)) for r in rows], pa.schema([("video_id", pa.string()), ("frame_index", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())]))
    for most, firsts in ((video.RUN_BYTES, [0, 101, 102, 103]), (1000, [0, 50, 101, 102, 103])):
        monkeypatch.setattr(video, "RUN_BYTES", most)
        (out,) = video._runs(iter([batch.slice(0, 0), batch]))
        assert [r["first"] for r in out.to_pylist()] == firsts
        assert [x for r in out.to_pylist() for x in [pa.decompress(r["frames"], 20 * r["n"], "zstd").to_pybytes()[k : k + 20] for k in range(0, 20 * r["n"], 20)]] == [r[4] for r in rows]
        (tail,) = video._runs(iter([batch.slice(98)]))
        assert [(r["first"], r["n"]) for r in tail.to_pylist()] == [(98, 2), (101, 1), (102, 1), (103, 1)]


def wav(path, samples, rate, channels):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(samples.astype("<i2").tobytes())


@pytest.fixture(scope="module")
def sounds(tmp_path_factory):
    root = tmp_path_factory.mktemp("sounds")
    rng = np.random.default_rng(2)
    made = {"a.wav": (rng.integers(-(2**15), 2**15, (3000, 2)), 22050, 2), "b.wav": (rng.integers(-(2**15), 2**15, (501, 1)), 8000, 1), "empty.wav": (np.zeros((0, 1)), 8000, 1), "same.wav": (rng.integers(-99, 99, (400, 1)), 16000, 1)}
    for name, (x, rate, channels) in made.items():
        wav(root / name, x, rate, channels)
    return root, made


def slow(x, rate, target, crossings=audio.CROSSINGS):
    """Every new sample from all old ones, by the formula."""
    down = min(1.0, target / rate)
    out = []
    for n in range(-(-len(x) * target // rate)):
        at = n * rate / target
        low = int(np.floor(n * rate / target))
        k = np.arange(low - int(np.ceil(crossings / down)), low + int(np.ceil(crossings / down)) + 2)
        d = at - k
        w = np.where(np.abs(d) < crossings / down, np.sinc(d * down) * (0.5 + 0.5 * np.cos(np.pi * d * down / crossings)), 0)
        some = (k >= 0) & (k < len(x))
        out.append((x[k[some]] * w[some]).sum() / w.sum())
    return np.array(out)


@pytest.mark.parametrize("chunk", [1 << 18, 700, 64])
def test_resampling_by_chunks_is_that_of_whole_sounds(spark, sounds, chunk):
    root, made = sounds
    chunks = sound.samples(spark, str(root), chunk)
    got = {}
    for r in audio.sample_rows(audio.resampled(chunks, 16000)).collect():
        got.setdefault(r["video_id"], {})[r["index"]] = r["value"]
    assert set(got) == {"a.wav", "b.wav", "same.wav"}
    for name, values in got.items():
        x, rate, _ = made[name]
        want = slow(x.mean(axis=1) / 2**15, rate, 16000)
        assert sorted(values) == list(range(len(want)))
        assert np.allclose([values[k] for k in range(len(want))], want, atol=1e-12)
    assert np.allclose([got["same.wav"][k] for k in range(400)], made["same.wav"][0][:, 0] / 2**15, atol=1e-12)


def test_a_tone_stays_and_what_is_too_high_goes(spark):
    t = np.arange(8000) / 44100
    tone = lambda f: np.sin(2 * np.pi * f * t)
    rows = [("low", 0, 0, 44100, tone(1000).tolist()), ("high", 0, 0, 44100, tone(15000).tolist())]
    out = {r["video_id"]: np.array(r["samples"]) for r in audio.resampled(spark.createDataFrame(rows, audio.CHUNKS), 16000).collect()}
    n = np.arange(len(out["low"]))
    inner = slice(100, -100)
    assert np.abs(out["low"] - np.sin(2 * np.pi * 1000 * n / 16000))[inner].max() < 0.01
    assert np.abs(out["high"][inner]).max() < 0.02


def test_short_chunks_and_other_files_are_errors(spark, sounds, tmp_path):
    rows = [("a", 0, 0, 8000, [0.1] * 50), ("a", 1, 50, 8000, [0.1] * 3), ("a", 2, 53, 8000, [0.1] * 50)]
    with pytest.raises(Exception, match="shorter than the filter"):
        audio.resampled(spark.createDataFrame(rows, audio.CHUNKS), 16000).collect()
    (tmp_path / "x.wav").write_bytes(b"RIFF" + struct.pack("<I", 4) + b"WAVX")
    with pytest.raises(Exception, match="RIFF"):
        sound.samples(spark, str(tmp_path / "x.wav")).collect()
    assert sound.samples(spark, str(sounds[0] / "empty.wav")).count() == 0
