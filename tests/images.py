"""Small PNG files for reader tests."""

import struct
import zlib

import numpy as np


def write_png(path, rgb: np.ndarray) -> None:
    height, width, _ = rgb.shape
    raw = b"".join(b"\x00" + rgb[y].astype(np.uint8).tobytes() for y in range(height))

    def chunk(tag: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def frame_rows(frames, source="clip"):
    return [
        (source, i, f.shape[1], f.shape[0], f.shape[2], bytearray(np.ascontiguousarray(f, dtype=np.uint8).tobytes()))
        for i, f in enumerate(frames)
    ]


FRAMES = "source_id string, frame_index int, width int, height int, channels int, pixels binary"


def as_arrays(df):
    rows = df.orderBy("frame_index").collect()
    return [np.frombuffer(bytes(r.pixels), dtype=np.uint8).reshape(r.height, r.width, r.channels) for r in rows]
