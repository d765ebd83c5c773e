"""Media columns: payloads stored as lossless WebP, read back as pixel arrays.

``stored`` turns texts into media: UTF-8 bytes, padded by zeros to a positive
multiple of 64, as grey images (see ``webp``).  ``loaded`` decodes any lossless
WebP column to width, height, pixels (8-bit samples, rows one after the other,
red, green, blue, alpha) and the grey samples, with features of the samples.

Cases: null and empty texts are one row of zeros; a text above ``webp.PIECE``
bytes makes several files in one column value, whose pixel rows follow each
other.  Equal texts give equal media.  A null media value is loaded as null;
damaged media is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.llm import webp


def stored(text: Column) -> Column:
    """Struct (n_bytes, media)."""

    @F.arrow_udf("n_bytes long, media binary")
    def apply(texts: pa.Array) -> pa.Array:
        sizes, media = [], []
        for t in texts:
            b = (t.as_py() or "").encode()
            sizes.append(len(b))
            media.append(webp.encode(b + bytes(-len(b) % webp.WIDTH if b else webp.WIDTH)))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["n_bytes", "media"])

    return apply(text)


def feature(samples: np.ndarray) -> str:
    """Rows, mean, spread, mean step between neighbours (thousandths) and the shares of eight bands (thousandths)."""
    x = samples.astype(np.int64)
    n, total = len(x), int(x.sum())
    spread = (n * int((x * x).sum()) - total * total) * 1000 // (n * n)
    step = int(np.abs(np.diff(x)).sum()) * 1000 // max(1, n - 1)
    bands = np.bincount(x >> 5, minlength=8) * 1000 // n
    return f"r{n // webp.WIDTH} m{total * 1000 // n} v{spread} d{step} b{'-'.join(map(str, bands.tolist()))}"


def loaded(media: Column, pixels: bool = True) -> Column:
    """Struct (width, height, pixels, grey, feature); ``pixels`` may be left out."""

    @F.arrow_udf("width int, height int, pixels binary, grey binary, feature string")
    def apply(column: pa.Array) -> pa.Array:
        rows = []
        for m in column:
            if not m.is_valid:
                rows.append(None)
                continue
            images = webp.decode(m.as_py())
            if len({i.shape[1] for i in images}) != 1:
                raise ValueError("the images of a value differ in width")
            grey = np.concatenate([i[..., 1].ravel() for i in images])
            rows.append({
                "width": images[0].shape[1], "height": sum(i.shape[0] for i in images),
                "pixels": b"".join(i[..., [2, 1, 0, 3]].tobytes() for i in images) if pixels else None,
                "grey": grey.tobytes(), "feature": feature(grey)})
        return pa.array(rows, pa.struct([("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary()), ("grey", pa.binary()), ("feature", pa.string())]))

    return apply(media)
