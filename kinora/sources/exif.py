"""Size and EXIF fields read from a file's bytes: JPEG, PNG, WebP, BMP, TIFF and raw formats built on TIFF.

Nothing is decoded and nothing has to be installed.  Only fields of ``FIELDS`` are read, each by its tag and directory;
one that is missing, damaged or not a number where a number belongs is left out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

# Tags of the TIFF 6.0 and EXIF 2.3 standards, by directory, with the name that the catalog gives them.
MAIN, DETAIL, PLACE = "main", "detail", "place"
FIELDS = {
    (MAIN, 0x0100): "ImageWidth",
    (MAIN, 0x0101): "ImageHeight",
    (MAIN, 0x010F): "Make",
    (MAIN, 0x0110): "Model",
    (DETAIL, 0x829A): "ExposureTime",
    (DETAIL, 0x829D): "FNumber",
    (DETAIL, 0x8827): "ISO",
    (DETAIL, 0x9003): "DateTimeOriginal",
    (DETAIL, 0x9004): "CreateDate",
    (DETAIL, 0x920A): "FocalLength",
    (DETAIL, 0xA434): "LensModel",
}
POINTERS = {0x8769: DETAIL, 0x8825: PLACE}
ORIENTATION = 0x0112
#: By a value's type: its bytes and how struct reads it; ratios are two of them, 2 is text.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 9: (4, "i"), 10: (8, "ii")}
#: Entries of a directory that are looked at.
MOST = 4096


def entries(data: bytes, order: str, at: int) -> Iterator[tuple[int, object]]:
    """(tag, value) of the directory at an offset: text, a number, or a tuple of numbers."""
    if at + 2 > len(data):
        return
    (n,) = struct.unpack_from(f"{order}H", data, at)
    for k in range(min(n, MOST)):
        here = at + 2 + 12 * k
        if here + 12 > len(data):
            return
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, here)
        size, code = TYPES.get(kind, (0, ""))
        total = size * count
        start = here + 8 if total <= 4 else struct.unpack_from(f"{order}I", data, here + 8)[0]
        if not size or not count or count > 65535 or start + total > len(data):
            continue
        if kind == 2:
            yield tag, data[start : start + count].split(b"\0")[0].decode("utf-8", "replace").strip()
            continue
        numbers = struct.unpack_from(f"{order}{code * count}", data, start)
        if len(code) == 2:
            numbers = tuple(a / b if b else None for a, b in zip(numbers[::2], numbers[1::2]))
        yield tag, numbers[0] if count == 1 else numbers


def degrees(value: object, side: object) -> float | None:
    """Degrees, minutes and seconds as one number, negative in the south and west."""
    if not isinstance(value, tuple) or len(value) != 3 or None in value:
        return None
    return (value[0] + value[1] / 60 + value[2] / 3600) * (-1 if str(side).upper()[:1] in ("S", "W") else 1)


def directories(tiff: bytes) -> dict[tuple[str, int], object]:
    """Values by directory and tag, the first of each."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return {}
    found: dict[tuple[str, int], object] = {}
    todo = [(MAIN, struct.unpack_from(f"{order}I", tiff, 4)[0])]
    while todo:
        name, at = todo.pop()
        for tag, value in entries(tiff, order, at):
            if name == MAIN and tag in POINTERS and isinstance(value, int):
                todo.append((POINTERS[tag], value))
            found.setdefault((name, tag), value)
    return found


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, bytes) of the parts of a container that may hold a size or EXIF."""
    if data[:2] == b"\xff\xd8":  # JPEG: marker, length, segment
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
            (length,) = struct.unpack_from(">H", data, at + 2)
            yield data[at + 1 : at + 2], data[at + 4 : at + 2 + length]
            at += 2 + length
    elif data[:8] == b"\x89PNG\r\n\x1a\n":  # length, kind, chunk, checksum
        at = 8
        while at + 8 <= len(data):
            (length,) = struct.unpack_from(">I", data, at)
            yield data[at + 4 : at + 8], data[at + 8 : at + 8 + length]
            at += 12 + length
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":  # kind, length, chunk, padding
        at = 12
        while at + 8 <= len(data):
            (length,) = struct.unpack_from("<I", data, at + 4)
            yield data[at : at + 4], data[at + 8 : at + 8 + length]
            at += 8 + length + length % 2
    elif data[:2] in (b"II", b"MM"):
        yield b"tiff", data


def _tiff(data: bytes) -> dict[tuple[str, int], object]:
    for kind, part in chunks(data):
        if kind == b"\xe1" and part[:6] == b"Exif\0\0":
            return directories(part[6:])
        if kind in (b"eXIf", b"EXIF", b"tiff"):
            return directories(part.removeprefix(b"Exif\0\0"))
    return {}


def fields(data: bytes) -> dict[str, object]:
    """The known fields that the file has."""
    found = _tiff(data)
    out = {name: found[key] for key, name in FIELDS.items() if found.get(key) not in (None, "") and not isinstance(found[key], tuple)}
    for name, side, value in (("GPSLatitude", 1, 2), ("GPSLongitude", 3, 4)):
        if (at := degrees(found.get((PLACE, value)), found.get((PLACE, side)))) is not None:
            out[name] = at
    return out


def turns(data: bytes) -> int:
    """The EXIF orientation, 1 to 8; 1 if there is none."""
    found = _tiff(data).get((MAIN, ORIENTATION))
    return found if isinstance(found, int) and 1 <= found <= 8 else 1


def _stored_size(data: bytes) -> tuple[int, int] | None:
    if data[:2] == b"BM" and len(data) >= 26:
        width, height = struct.unpack_from("<ii", data, 18)
        return width, abs(height)
    for kind, part in chunks(data):
        if len(kind) == 1 and 0xC0 <= kind[0] <= 0xCF and kind[0] not in (0xC4, 0xC8, 0xCC) and len(part) >= 5:
            return struct.unpack_from(">HH", part, 1)[::-1]
        if kind == b"IHDR" and len(part) >= 8:
            return struct.unpack_from(">II", part)
        if kind == b"VP8X" and len(part) >= 10:
            return int.from_bytes(part[4:7], "little") + 1, int.from_bytes(part[7:10], "little") + 1
        if kind == b"VP8L" and len(part) >= 5:
            bits = int.from_bytes(part[1:5], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        if kind == b"VP8 " and len(part) >= 10:
            width, height = struct.unpack_from("<HH", part, 6)
            return width & 0x3FFF, height & 0x3FFF
        if kind == b"tiff":
            found = directories(part)
            sides = found.get((MAIN, 0x0100)), found.get((MAIN, 0x0101))
            return sides if all(isinstance(s, int) for s in sides) else None
    return None


def size(data: bytes) -> tuple[int, int] | None:
    """Width and height of the upright image, or None for a file that does not say."""
    found = _stored_size(data)
    return found if found is None or turns(data) < 5 else found[::-1]
