"""Frame files: partial reads, compressions, CBF files, and damaged ones."""

import struct

import numpy as np
import pytest

from voxelmill.jobs.process import load_folder, read_any
from voxelmill.sources import codecs, frame_source, frames

RNG = np.random.default_rng(7)
HARD = np.array([0, 126, -1, 253, 126, -128, 2**15, -(2**15), 2**31 - 1, -(2**31), -(2**31), 2**31 - 1, 5, 5, 127, 254], np.int32)


def image(pixels, l=0.5, compressed=False, nx=4):
    pixels = np.asarray(pixels, np.int32)
    head = bytearray(frames.HEADER_BYTES)
    body = pixels.tobytes()
    text = b"OD SAPPHIRE  4.0\r\n"
    if compressed:
        body, short, long = codecs.encode_differences(pixels)
        text += f"COMPRESSION=TY1\r\nNX={nx:4d} NY={len(pixels) // nx:4d} OI={short:7d} OL={long:7d} \r\n".encode()
    head[: len(text)] = text
    for name, value in {"nx": nx, "ny": len(pixels) // nx, "fixed_l": l, "x_h": 1.0, "y_k": 1.0, "d_min": 0.8, "wavelength": 0.7}.items():
        at, kind = frames.OFFSETS[name]
        struct.pack_into(kind, head, at, value)
    struct.pack_into("<9d", head, frames.UB_OFFSET, 0.1, 0, 0, 0, 0.1, 0, 0, 0, 0.1)
    return bytes(head) + body


@pytest.mark.parametrize("pixels", [HARD, np.zeros(0, np.int32), np.full(16, 7), RNG.integers(-40, 40, 4000).cumsum(), RNG.integers(-(2**31), 2**31, 4000), RNG.poisson(20, 4000) * (RNG.random(4000) < 0.1) * 900])
def test_payloads_survive_both_encodings(pixels):
    pixels = pixels.astype(np.int32)
    body, short, long = codecs.encode_differences(pixels)
    assert (codecs.decode_differences(body, len(pixels), short, long) == pixels).all()
    assert (codecs.decode_offsets(codecs.encode_offsets(pixels), len(pixels)) == pixels).all()


def test_differences_by_hand():
    assert codecs.encode_differences([1, 127, 0, 254, -40000]) == (bytes([128, 253, 0, 254, 255]) + struct.pack("<hi", 254, -40254), 1, 1)
    assert codecs.encode_offsets([1, 128, 0, 40000, 2**40]) == struct.pack("<bbbhbhibhiq", 1, 127, -128, -128, -128, -(2**15), 40000, -128, -(2**15), -(2**31), 2**40 - 40000)


def test_wide_offsets_hold_escape_bytes():
    pixels = np.array([0, -128, 2**40, -(2**40), 0x8080, 0x80808080, 3, -32768, 127, -128], np.int64)
    assert (codecs.decode_offsets(codecs.encode_offsets(pixels), len(pixels)) == pixels).all()


def test_the_header_names_the_compression():
    pixels = RNG.integers(-300, 70000, 20)
    assert (codecs.frame_pixels(image(pixels)) == pixels).all() and (codecs.frame_pixels(image(pixels, compressed=True)) == pixels).all()


@pytest.mark.parametrize("harm", [lambda b: b[:-3], lambda b: b.replace(b"OI=", b"OI=1"), lambda b: b.replace(b"TY1", b"TY9")])
def test_damaged_frames_say_so(harm):
    pixels = RNG.integers(-300, 70000, 20)
    with pytest.raises(ValueError, match="damaged|compression"):
        codecs.frame_pixels(harm(image(pixels, compressed=True)))
    with pytest.raises(ValueError, match="damaged"):
        codecs.frame_pixels(image(pixels)[:-1])
    body = codecs.encode_offsets(HARD)
    for cut in range(len(body)):
        with pytest.raises(ValueError, match="damaged"):
            codecs.decode_offsets(body[:cut], len(HARD))


def test_cbf_files(spark, tmp_path):
    pixels = RNG.integers(-2, 70000, (5, 7))
    (tmp_path / "a.cbf").write_bytes(codecs.encode_cbf(pixels))
    one = read_any(spark, str(tmp_path / "a.cbf"))
    row = one.first()
    assert (row.nx, row.ny) == (7, 5) and row.payload == pixels.ravel().tolist()
    got = {(r.row, r.col): r.val for r in frames.frame_image(one).collect()}
    assert got == {at: float(v) for at, v in np.ndenumerate(pixels)}
    text = codecs.encode_cbf(pixels)
    for harm in (text.replace(codecs.CBF_MAGIC, b""), text.replace(b"BYTE_OFFSET", b"PACKED"), text.replace(b"Second", b"Other"), text[: text.index(codecs.CBF_MAGIC) + 12]):
        with pytest.raises(ValueError):
            codecs.cbf_pixels(harm)


@pytest.fixture
def folder(tmp_path):
    for i in range(5):
        (tmp_path / f"a_{i}.{'IMG' if i == 3 else 'img'}").write_bytes(image(RNG.integers(0, 99, 400), i / 2, compressed=i % 2 == 0, nx=20))
    (tmp_path / "b_9.img").write_bytes(image(range(400), nx=20))
    (tmp_path / "short.img").write_bytes(b"x")
    (tmp_path / "notes.txt").write_text("no frame")
    return tmp_path


class Counted:
    """A file that counts what is read of it."""

    total: list = []

    def __init__(self, inner):
        self.inner = inner

    def __enter__(self):
        return self

    def __exit__(self, *e):
        self.inner.close()

    def read(self, *n):
        got = self.inner.read(*n)
        self.total.append(len(got))
        return got


@pytest.mark.parametrize("payload", [False, True])
def test_bytes_read_of_each_file(folder, monkeypatch, payload):
    plain = frame_source.filesystem

    class System:
        def __init__(self, system):
            self.get_file_info = system.get_file_info
            self.open_input_file = lambda p: Counted(system.open_input_file(p))

    monkeypatch.setattr(frame_source, "filesystem", lambda p: (System(plain(p)[0]), plain(p)[1]))
    monkeypatch.setattr(Counted, "total", [])
    reader = frame_source.FrameReader({"path": str(folder), "pattern": "a_*.img"}, payload, codecs.frame_pixels)
    rows = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
    sizes = sorted(f.stat().st_size for f in folder.glob("a_*"))
    assert len(rows) == 5 and sorted(Counted.total) == (sizes if payload else [frame_source.NEEDED] * 5)


def test_headers_need_no_more_than_their_bytes(spark, folder):
    want = sorted(map(tuple, frames.read_frames(spark, str(folder), pattern="a_*.img").drop("bytes_read").collect()))
    for f in folder.glob("a_*"):
        f.write_bytes(f.read_bytes()[: frame_source.NEEDED])
    got = frames.read_frames(spark, str(folder), pattern="a_*.img")
    assert sorted(map(tuple, got.drop("bytes_read").collect())) == want and {r.bytes_read for r in got.collect()} == {frame_source.NEEDED}


def test_filters_leave_files_unopened(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        (folder / "a_1.img").write_bytes(b"")  # would be an error if it was opened for its pixels
        got = frames.read_frames(spark, str(folder), payload=True, pattern="a_*.img").where("file_no >= 2 and file_no < 4")
        assert sorted(r.file_no for r in got.collect()) == [2, 3]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = frame_source.FilteringReader({"path": str(folder)}, False, codecs.frame_pixels)
    left = list(reader.pushFilters([frame_source.In(("path",), (f"{folder}/a_2.img", f"{folder}/b_9.img")), frame_source.EqualTo(("nx",), 20)]))
    assert [type(f) for f in left] == [frame_source.EqualTo] and [p.rsplit("/", 1)[1] for p, _ in reader.files()] == ["a_2.img", "b_9.img"]


def test_tasks_hold_files_by_size(folder, monkeypatch):
    monkeypatch.setattr(frame_source, "TASK_BYTES", 2 * frame_source.NEEDED)
    reader = frame_source.FrameReader({"path": str(folder), "pattern": "a_*.img"}, False, codecs.frame_pixels)
    assert [len(p.value) for p in reader.partitions()] == [2, 2, 1]


def test_folders_load_alike_by_partial_and_by_whole_reads(spark, folder, monkeypatch):
    v = load_folder(spark, f"file:{folder}")
    want = sorted(map(tuple, v.voxels.collect()))
    assert v.grid.axes[2] == (0.0, 0.5, 1.0, 1.5, 2.0) and len(want) == 2000 and v.meta["n_files"] == 5

    def closed(path):
        raise ValueError

    monkeypatch.setattr(frames, "filesystem", closed)
    assert sorted(map(tuple, load_folder(spark, str(folder)).voxels.collect())) == want


def test_a_frame_cut_off_in_its_header_is_named(spark, folder):
    (folder / "a_4.img").write_bytes(b"x" * 100)
    with pytest.raises(ValueError, match="a_4.img is too short"):
        load_folder(spark, str(folder))


def test_another_decoder(spark, folder):
    got = frames.read_layers(spark, f"{folder}/b_*.img", codec=lambda content: np.arange(400) * 2)
    assert got.first().payload == list(range(0, 800, 2))
