import json
import struct
import zlib

import numpy as np
import pytest

from kinora.functions import geometry
from kinora.sources import exif, images


def tiff(order, main, detail=(), place=()):
    """A TIFF block of (tag, type, value) entries; values that do not fit an entry follow the directories."""

    def packed(kind, value):
        if kind == 2:
            return value + b"\0", len(value) + 1
        values = value if isinstance(value, list) else [value]
        return b"".join(struct.pack(order + {1: "B", 3: "H", 4: "I", 5: "II", 10: "ii"}[kind], *(v if isinstance(v, tuple) else (v,))) for v in values), len(values)

    places, at, sections = [], 8, [list(main), list(detail), list(place)]
    if detail:
        sections[0].append((0x8769, 4, None))
    if place:
        sections[0].append((0x8825, 4, None))
    for section in sections:
        places.append(at)
        at += 2 + 12 * len(section) + 4
    out, extra = b"", b""
    pointers = {0x8769: places[1], 0x8825: places[2]}
    for section in sections:
        out += struct.pack(order + "H", len(section))
        for tag, kind, value in section:
            data, n = packed(kind, pointers[tag] if tag in pointers else value)
            if len(data) > 4:
                out += struct.pack(order + "HHII", tag, kind, n, at + len(extra))
                extra += data
            else:
                out += struct.pack(order + "HHI", tag, kind, n) + data.ljust(4, b"\0")
        out += b"\0" * 4
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + out + extra


def jpeg(width, height, block=None):
    parts = [(0xE1, b"Exif\0\0" + block)] if block else []
    parts += [(0xC4, b"tables"), (0xC0, struct.pack(">BHHB", 8, height, width, 3) + b"\0" * 9)]
    return b"\xff\xd8" + b"".join(b"\xff" + bytes([m]) + struct.pack(">H", len(p) + 2) + p for m, p in parts) + b"\xff\xda\0\x02"


def png(width, height, block=None):
    parts = [(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)), *([(b"eXIf", block)] if block else []), (b"IDAT", zlib.compress(b"")), (b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(p)) + k + p + struct.pack(">I", zlib.crc32(k + p)) for k, p in parts)


def webp(kind, part):
    body = b"WEBP" + kind + struct.pack("<I", len(part)) + part
    return b"RIFF" + struct.pack("<I", len(body)) + body


MAIN = [(0x010F, 2, b"Maker"), (0x0110, 2, b"M1"), (0x0112, 3, 1)]
DETAIL = [(0x829A, 5, (1, 250)), (0x829D, 5, (28, 10)), (0x8827, 3, 400), (0x9003, 2, b"2020:01:02 03:04:05"), (0x920A, 5, (50, 0)), (0xA434, 2, b"Lens  ")]
PLACE = [(1, 2, b"S"), (2, 5, [(10, 1), (30, 1), (36, 1)]), (3, 2, b"E"), (4, 5, [(20, 1), (0, 1), (0, 1)])]
WANTED = {"Make": "Maker", "Model": "M1", "ExposureTime": 0.004, "FNumber": 2.8, "ISO": 400, "DateTimeOriginal": "2020:01:02 03:04:05", "LensModel": "Lens", "GPSLatitude": -10.51, "GPSLongitude": 20.0}


@pytest.mark.parametrize("order", ["<", ">"])
def test_fields_of_every_container(order):
    block = tiff(order, MAIN, DETAIL, PLACE)
    for data in (jpeg(4, 3, block), png(4, 3, block), webp(b"EXIF", block), block):
        found = exif.fields(data)
        assert {k: round(v, 9) if isinstance(v, float) else v for k, v in found.items()} == WANTED
        json.dumps(found)


def test_sizes():
    assert exif.size(jpeg(640, 480)) == exif.size(png(640, 480)) == (640, 480)
    assert exif.size(jpeg(640, 480, tiff("<", [(0x0112, 3, 6)]))) == (480, 640)
    assert exif.size(tiff(">", [(0x0100, 4, 7), (0x0101, 3, 9)])) == (7, 9)
    assert exif.size(b"BM" + b"\0" * 16 + struct.pack("<ii", 12, -34)) == (12, 34)
    assert exif.size(webp(b"VP8X", b"\0" * 4 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little"))) == (100, 50)
    assert exif.size(webp(b"VP8L", b"\x2f" + (15 | 7 << 14).to_bytes(4, "little"))) == (16, 8)
    assert exif.size(webp(b"VP8 ", b"\0" * 6 + struct.pack("<HH", 21, 22))) == (21, 22)
    assert exif.size(b"") is exif.size(b"text") is exif.size(b"\xff\xd8\xff") is None


def test_damaged_bytes_have_no_fields():
    whole = jpeg(4, 3, tiff("<", MAIN, DETAIL, PLACE))
    for n in range(len(whole)):
        exif.fields(whole[:n])
        exif.size(whole[:n])
    rng = np.random.default_rng(1)
    for _ in range(300):
        data = bytearray(whole)
        for k in rng.integers(0, len(data), 5):
            data[k] = rng.integers(256)
        json.dumps(exif.fields(bytes(data)))


def test_orientations():
    stored = np.arange(6).reshape(2, 3, 1)
    shown = {1: [[0, 1, 2], [3, 4, 5]], 2: [[2, 1, 0], [5, 4, 3]], 3: [[5, 4, 3], [2, 1, 0]], 4: [[3, 4, 5], [0, 1, 2]], 5: [[0, 3], [1, 4], [2, 5]], 6: [[3, 0], [4, 1], [5, 2]], 7: [[5, 2], [4, 1], [3, 0]], 8: [[2, 5], [1, 4], [0, 3]]}
    for k, want in shown.items():
        assert images.upright(stored, k)[:, :, 0].tolist() == want


def test_shrinking_keeps_averages_and_fits_as_columns_do(spark):
    rng = np.random.default_rng(3)
    pixels = rng.integers(0, 256, (90, 141, 3)).astype(np.uint8)
    small = images.shrunk(pixels, 47)
    assert small.shape == (30, 47, 3) and abs(small.mean() - pixels.mean()) < 1
    assert np.abs(small[0, 0] - pixels[:3, :3].reshape(-1, 3).mean(axis=0)).max() <= 0.5 and images.shrunk(pixels, 200) is pixels
    sides = [(int(a), int(b)) for a, b in rng.integers(1, 5000, (200, 2))] + [(1600, 900), (1601, 1), (1, 1)]
    rows = spark.createDataFrame(sides, "w int, h int")
    got = rows.select("w", "h", *(c.alias(n) for c, n in zip(geometry.detector_size(geometry.F.col("w"), geometry.F.col("h"), 1600)[:2], "xy"))).collect()
    assert all((r.x, r.y) == images.fitted(r.w, r.h, 1600) for r in got)
    boxes = [(*map(int, rng.integers(-50, 400, 4)), int(rng.integers(1, 300)), int(rng.integers(1, 300))) for _ in range(200)]
    table = spark.createDataFrame(boxes, "a int, b int, c int, d int, w int, h int")
    got = table.select("*", *(c.alias(f"o{k}") for k, c in enumerate(geometry.padded(*(geometry.F.col(x) for x in "abcdwh"))))).collect()
    assert all(tuple(r[6:]) == images.around([r.a, r.b, r.c, r.d], r.w, r.h) for r in got)
