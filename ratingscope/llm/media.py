"""Media columns of progressive JPEG files (operator 10).

``store`` puts bytes into a file losslessly, ``load`` reads files back: scans are accumulated into
coefficient arrays, inverse-transformed with numpy, chroma is brought to full resolution, and the RGB
tensor is a column. A byte is one quantised coefficient, the format's own unit: samples that went through
the transform and its rounding would not come back exactly, coefficients do.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingscope.llm import jpeg
from ratingscope.llm.common import map_slices

#: Bytes of a block; payloads are whole blocks.
BLOCK = 64
#: A byte b is the coefficient b + 2, whose upper bits are never 0, so that no scan has runs of zeros.
OFFSET = 2


def pack(payload: bytes) -> bytes:
    """A progressive file, luma at 2 x 2 to chroma, whose blocks in order hold the payload; the payload's
    length is in a comment."""
    if len(payload) % BLOCK:
        raise ValueError("the payload is not of whole blocks")
    units = max(1, -(-len(payload) // (6 * BLOCK)))
    across = math.isqrt(units - 1) + 1
    down = -(-units // across)
    image = jpeg.Image(across * 16, down * 16, [jpeg.Component(1, 2, 2, 0), jpeg.Component(2, 1, 1, 0), jpeg.Component(3, 1, 1, 0)], {0: np.ones(64, np.int32)}, [len(payload).to_bytes(8, "big")])
    image.layout()
    data = np.full(6 * across * down * BLOCK, OFFSET, np.int32)
    data[: len(payload)] += np.frombuffer(payload, np.uint8)
    at = 0
    for c in image.components:
        c.coef = data[at : at + c.coef.size].reshape(-1, BLOCK)
        at += c.coef.size
    return jpeg.write(image)


def unpack(image: jpeg.Image) -> bytes:
    """The payload of a file that ``pack`` made."""
    size = int.from_bytes(image.comments[0], "big")
    return (np.concatenate([c.coef.ravel() for c in image.components])[:size] - OFFSET).astype(np.uint8).tobytes()


def describe(rgb: np.ndarray) -> str:
    """Size, mean of each channel, and the mean step between neighbours across and down."""
    x = rgb.astype(np.int64)
    mean = [f"{m:.3f}" for m in x.mean(axis=(0, 1))]
    steps = [f"{np.abs(np.diff(x, axis=a)).mean():.3f}" for a in (1, 0)]
    return f"{rgb.shape[0]}x{rgb.shape[1]} mean {' '.join(mean)} step {' '.join(steps)}"


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes long, media binary): the UTF-8 bytes of every text, then bytes 0 up to the next positive
    multiple of 64, as a progressive JPEG file.

    A null text is an empty one, a payload of 64 zeros. Equal texts give equal files; repeated rows stay
    repeated; other columns are not read. Files have up to 65,535 samples each way, which is room for
    texts of 6 GB. A map without shuffle."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(cols: list[list]) -> list[list]:
        raw = [(t or "").encode() for t in cols[1]]
        return [cols[0], [len(x) for x in raw], [pack(x.ljust(max(1, -(-len(x) // BLOCK)) * BLOCK, b"\0")) for x in raw]]

    return map_slices(df.select(id_col, text_col), run, f"`{id_col}` {kind}, n_bytes long, media binary", rows=64)


def load(df: DataFrame, id_col: str = "doc_id", keep: tuple[str, ...] = ("n_bytes",)) -> DataFrame:
    """(id, kept columns, media, payload binary, height int, width int, rgb binary, feature string) of files.

    rgb is the full-resolution tensor of height x width x 3 bytes. A null file gives nulls. The payload is that of files
    which ``store`` made; of other progressive files it is null. A file that is no progressive
    JPEG is an error, for a wrong column is better noticed than skipped."""
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (id_col, *keep)]

    def run(cols: list[list]) -> list[list]:
        out = []
        for data in cols[-1]:
            if data is None:
                out.append((None,) * 5)
                continue
            image = jpeg.read(data)
            payload = unpack(image) if image.comments and len(image.comments[0]) == 8 else None
            tensor = jpeg.rgb(image)
            out.append((payload, image.height, image.width, tensor.tobytes(), describe(tensor)))
        return [*cols, *([x[k] for x in out] for k in range(5))]

    schema = ", ".join(kinds) + ", media binary, payload binary, height int, width int, rgb binary, feature string"
    return map_slices(df.select(id_col, *keep, "media"), run, schema, rows=64)


def digests(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Lengths and digests of payload and file, by Spark's own functions."""
    size = F.octet_length
    return df.select(
        id_col,
        "n_bytes",
        size("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, octet_length(payload) - {BLOCK - 1}, {BLOCK})")).alias("tail_crc32"),
        size("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "height",
        "width",
        size("rgb").cast("long").alias("rgb_bytes"),
    )
