"""Decoding and detection as one fused Arrow step, a detector per Python worker; a bad file is a row, not a failure."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from kinora.sources import exif
from kinora.sources.images import Codec, shrunk

SCHEMA = (
    "path string, ok boolean, error string, width int, height int, exif string, "
    "face_index int, bbox array<int>, det_score double, quality_score double, embedding array<float>"
)
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


class FaceDetector(Protocol):
    """Anything that finds faces in a file's bytes, or with ``pixels = True`` in a decoded image; made once per worker."""

    def load(self) -> FaceDetector: ...

    def detect(self, content) -> list[dict]:
        """Per face ``bbox`` (four numbers), ``det_score`` and a unit ``embedding``; raises for what it cannot read."""
        ...


class FakeDetector:
    """Deterministic faces from a hash of the bytes, for tests: none to two per file."""

    def __init__(self, dimension: int):
        self.dimension = dimension

    def load(self) -> FakeDetector:
        return self

    def detect(self, content: bytes) -> list[dict]:
        if not content:
            raise ValueError("empty file")
        seed = int.from_bytes(hashlib.sha256(content).digest()[:8])
        rng, found = np.random.default_rng(seed), []
        for _ in range(seed % 3):
            v = rng.standard_normal(self.dimension)
            x, y = rng.uniform(-20, 500, 2)
            found.append({"bbox": [x, y, x + rng.uniform(1, 90), y + rng.uniform(1, 90)], "det_score": float(rng.uniform()), "embedding": v / np.linalg.norm(v)})
        return found


def found_in(engine: FaceDetector, content: bytes, codec: Codec | None = None, longest: int = 1600, name: str = "") -> list[dict]:
    """The faces of a file, boxes in its own pixels.  Indexing and queries both come through here, so both shrink alike."""
    if not getattr(engine, "pixels", False):
        return engine.detect(content)
    if codec is None:
        raise ValueError("no codec that decodes images")
    pixels = codec.decode(content, name)
    small = shrunk(pixels, longest)
    back = max(pixels.shape[:2]) / longest if small.shape != pixels.shape else 1.0
    return [f | {"bbox": [x * back for x in f["bbox"]]} for f in engine.detect(small)]


def detect_faces(files: DataFrame, detector: FaceDetector, codec: Codec | None = None, longest: int = 1600) -> DataFrame:
    """``files`` (path, content) to one row per face, with the file's size and EXIF fields; a file without faces has one
    row without a face, as has a bad one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = detector.load()
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                data, none = bytes(content) if content is not None else b"", (None,) * 5
                try:
                    faces = found_in(engine, data, codec, longest, path)
                except Exception as e:  # noqa: BLE001  an unreadable file must not end the run
                    rows.append((path, False, str(e), None, None, None, *none))
                    continue
                about = (path, True, None, *(exif.size(data) or (None, None)), json.dumps(exif.fields(data)))
                rows += [(*about, k, [int(x) for x in f["bbox"]], f["det_score"], f.get("quality_score", f["det_score"]), np.asarray(f["embedding"], dtype=np.float32)) for k, f in enumerate(faces)] or [(*about, *none)]
            yield pd.DataFrame(rows, columns=_COLUMNS).astype({"face_index": "Int32", "width": "Int32", "height": "Int32"})

    return files.select("path", "content").mapInPandas(run, SCHEMA)
