"""Raw pixels of embedded images: colour conversion, and the layout model's input tensors.

Images are rows with binary pixels; a task holds a few at a time, whatever a batch has."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# Bytes a pixel by colour space; the layout model's input and its normalisation.
CHANNELS = {"DeviceRGB": 3, "DeviceGray": 1, "DeviceCMYK": 4}
SIDE = 800
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def has_pixels(length: int | None, width: int | None, height: int | None, space: str | None) -> bool:
    """Whether so many bytes are an image of this size, in a known colour space."""
    channels = CHANNELS.get(space or "")
    return channels is not None and length is not None and bool(width and height) and width >= 1 and height >= 1 and length >= width * height * channels


def to_rgb(content: bytes | None, width: int | None, height: int | None, space: str | None) -> np.ndarray | None:
    """Pixels as (height, width, 3) bytes; None for an unknown colour space, a size that is none, or too few
    bytes. Bytes beyond the image are passed over."""
    if not has_pixels(None if content is None else len(content), width, height, space):
        return None
    channels = CHANNELS[space]
    return converted(np.frombuffer(content, np.uint8, width * height * channels).reshape(height, width, channels))


def converted(x: np.ndarray) -> np.ndarray:
    """Pixels of 1, 3 or 4 bytes, the last axis, as RGB."""
    channels = x.shape[-1]
    if channels == 3:
        return x
    if channels == 1:
        return np.repeat(x, 3, axis=-1)
    part = x.astype(np.float32) / np.float32(255)
    whole = np.float32(255) * (np.float32(1) - part[..., :3]) * (np.float32(1) - part[..., 3:])
    return whole.astype(np.uint8)


@lru_cache(maxsize=64)
def triangle(source: int, target: int) -> np.ndarray:
    """Weights (target, source) of resampling along one side with a triangle, which widens as it shrinks."""
    ratio = source / target
    wide = max(ratio, 1.0)
    centre = (np.arange(target) + 0.5) * ratio
    weight = np.maximum(0.0, 1.0 - np.abs((np.arange(source)[None, :] + 0.5 - centre[:, None]) / wide))
    return (weight / weight.sum(axis=1, keepdims=True)).astype(np.float32)


def resized(rgb: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Bytes of (side, side, 3), columns first; of images alike in size, one after another, if there are more axes."""
    down = np.einsum("yh,...hwc->...ywc", triangle(rgb.shape[-3], side), rgb.astype(np.float32), optimize=True)
    both = np.einsum("xw,...ywc->...yxc", triangle(rgb.shape[-2], side), down, optimize=True)
    return np.floor(np.clip(both, 0, 255) + np.float32(0.5)).astype(np.uint8)


def tensor(rgb: np.ndarray, side: int = SIDE) -> np.ndarray:
    """The model's input (3, side, side): channels first, each brought to mean 0 and deviation 1."""
    x = resized(rgb, side).astype(np.float32) / np.float32(255)
    return np.ascontiguousarray(np.moveaxis((x - np.array(MEAN, np.float32)) / np.array(DEVIATION, np.float32), -1, -3))


#: Columns of an image.
IMAGE = ["content", "width", "height", "space"]


def coloured(images: DataFrame, key: str) -> DataFrame:
    """Images (key, content, width, height, space) as RGB: key, width, height, rgb (row by row; null where
    ``to_rgb`` has none)."""
    kind = images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                content, width, height, space = (row.column(c)[0].as_py() for c in IMAGE)
                rgb = to_rgb(content, width, height, space)
                yield pa.RecordBatch.from_arrays([row.column(key), pa.array([width], pa.int32()), pa.array([height], pa.int32()), pa.array([None if rgb is None else rgb.tobytes()], pa.binary())], [key, "width", "height", "rgb"])

    return images.selectExpr(f"`{key}`", "content", "cast(width as int) width", "cast(height as int) height", "space").mapInArrow(run, f"`{key}` {kind}, width int, height int, rgb binary")


#: Bytes of images, or of tensors, that are made at once: a large image is alone.
AT_ONCE = 1 << 24


def model_inputs(images: DataFrame, key: str, side: int = SIDE) -> DataFrame:
    """The layout model's input of each image that has pixels: key, tensor (3 x side x side little-endian
    floats), scale_h and scale_w (input per pixel). A batch's images of one size and colour space are
    resampled together, as many as take ``AT_ONCE`` bytes."""
    kind = images.schema[key].dataType.simpleString()
    size = 12 * side * side

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike: dict[tuple, list[int]] = {}
            lengths = pc.binary_length(batch.column("content")).to_pylist()
            for i, (n, w, h, space) in enumerate(zip(lengths, *(batch.column(c).to_pylist() for c in IMAGE[1:]))):
                if has_pixels(n, w, h, space):
                    alike.setdefault((h, w, CHANNELS[space]), []).append(i)
            for (h, w, channels), rows in alike.items():
                whole = h * w * channels
                most = max(1, AT_ONCE // max(size, 12 * h * w))
                for a in range(0, len(rows), most):
                    some = pa.array(rows[a : a + most], pa.int64())
                    n = len(some)
                    content = b"".join([c[:whole] for c in batch.column("content").take(some).to_pylist()])
                    made = tensor(converted(np.frombuffer(content, np.uint8).reshape(n, h, w, channels)), side).astype("<f4", copy=False)
                    tensors = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(size)), pa.py_buffer(made)])
                    scales = [pa.array(np.full(n, np.float32(side) / np.float32(x), np.float32)) for x in (h, w)]
                    yield pa.RecordBatch.from_arrays([batch.column(key).take(some), tensors, *scales], [key, "tensor", "scale_h", "scale_w"])

    return images.selectExpr(f"`{key}`", "content", "cast(width as int) width", "cast(height as int) height", "space").mapInArrow(run, f"`{key}` {kind}, tensor binary, scale_h float, scale_w float")
