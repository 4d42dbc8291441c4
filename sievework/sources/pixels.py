"""Pixels of images: shrinking, and the encoding that a model server is sent.

Pixels are arrays of height x width x 3 bytes (RGB). JPEG needs Pillow, which is optional; without it
images are sent as PNG, made here, which model servers take as well.
"""

from __future__ import annotations

import base64
import importlib.util
import io
import struct
import zlib

import numpy as np

#: The longer side of what is sent, and the quality of its JPEG; fixed values.
LONGEST, QUALITY = 1024, 85
#: Extensions that only a decoder beside the usual ones reads.
HEIC = (".heic", ".heif")


def has_jpeg() -> bool:
    return importlib.util.find_spec("PIL") is not None


def has_heic() -> bool:
    return has_jpeg() and importlib.util.find_spec("pillow_heif") is not None


def readable(extensions: tuple[str, ...]) -> tuple[str, ...]:
    """The extensions without those that no decoder here reads."""
    return extensions if has_heic() else tuple(x for x in extensions if x not in HEIC)


def encoded_size(width: int, height: int, most: int = LONGEST) -> tuple[int, int]:
    """The size an image is shrunk to before it is sent: the longer side at most `most`, cut to whole pixels."""
    if max(width, height) <= most:
        return width, height
    ratio = most / max(width, height)
    return max(1, int(width * ratio)), max(1, int(height * ratio))


def rgb(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """Pixels from rows of grey, BGR or BGRA bytes, as Spark's image source has them."""
    rows = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(rows, 3, axis=2) if channels == 1 else rows[:, :, 2::-1]


def _weights(n: int, m: int) -> np.ndarray:
    """The Lanczos kernel (three lobes) that makes m samples of n, m < n."""
    scale = n / m
    centers = (np.arange(m) + 0.5) * scale - 0.5
    x = (np.arange(n)[None, :] - centers[:, None]) / scale
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)
    return w / w.sum(axis=1, keepdims=True)


def shrink(pixels: np.ndarray, most: int = LONGEST) -> np.ndarray:
    """The pixels at `encoded_size`, resampled along either side; small images stay as they are."""
    height, width = pixels.shape[:2]
    w, h = encoded_size(width, height, most)
    if (w, h) == (width, height):
        return pixels
    made = np.tensordot(_weights(height, h), pixels.astype(np.float32), 1) if h < height else pixels.astype(np.float32)
    made = np.einsum("xw,hwc->hxc", _weights(width, w), made) if w < width else made
    return np.clip(np.rint(made), 0, 255).astype(np.uint8)


def png(pixels: np.ndarray) -> bytes:
    """A PNG file of eight-bit RGB."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    height, width = pixels.shape[:2]
    rows = np.zeros((height, 1 + 3 * width), np.uint8)  # each row begins with its filter, none
    rows[:, 1:] = pixels.reshape(height, 3 * width)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def jpeg(pixels: np.ndarray) -> bytes:
    from PIL import Image

    out = io.BytesIO()
    Image.fromarray(pixels).save(out, "JPEG", quality=QUALITY)
    return out.getvalue()


def to_send(pixels: np.ndarray) -> str:
    """Base64 of the shrunk image, as JPEG where Pillow is there and PNG elsewhere."""
    return base64.b64encode((jpeg if has_jpeg() else png)(shrink(pixels))).decode()
