"""Image data operators (M1, M2, M5-M7).

M5 (resize + normalise) is the one step Spark has no built-in for; it runs
in ``mapInPandas`` on Arrow batches with numpy (bilinear resampling, BGR ->
RGB, ImageNet mean/std; or the browser rule: white background, centre crop,
resize), so decoding stays in the JVM and only the pixel arithmetic is
Python.  Everything else is column expressions and the split,
label-map and class-count operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwise.functions.predicates import label_from_depth, label_from_filename  # noqa: F401  (M1, M2)
from tabwise.operators.profile import class_distribution
from tabwise.operators.split import split_stratified

# fixed values: ImageNet channel statistics (RGB) and the model input size
IMAGENET_MEAN = [0.485, 0.456, 0.406]
IMAGENET_STD = [0.229, 0.224, 0.225]
TARGET_SIZE = 224


def _bilinear(img: np.ndarray, out_h: int, out_w: int) -> np.ndarray:
    """Bilinear resampling of an (h, w, c) float array (half-pixel centres)."""
    h, w = img.shape[:2]
    ys = (np.arange(out_h) + 0.5) * h / out_h - 0.5
    xs = (np.arange(out_w) + 0.5) * w / out_w - 0.5
    y0 = np.clip(np.floor(ys).astype(int), 0, h - 1)
    x0 = np.clip(np.floor(xs).astype(int), 0, w - 1)
    y1 = np.clip(y0 + 1, 0, h - 1)
    x1 = np.clip(x0 + 1, 0, w - 1)
    wy = np.clip(ys - np.floor(ys), 0, 1)[:, None, None]
    wx = np.clip(xs - np.floor(xs), 0, 1)[None, :, None]
    a = img[y0][:, x0]
    b = img[y0][:, x1]
    c = img[y1][:, x0]
    d = img[y1][:, x1]
    return (a * (1 - wy) * (1 - wx) + b * (1 - wy) * wx + c * wy * (1 - wx) + d * wy * wx)


def _to_rgb(buf: np.ndarray, ch: int, white_background: bool) -> np.ndarray:
    """(h, w, ch) decoded bytes (BGR / BGRA / gray) -> RGB floats; with
    ``white_background`` transparent pixels are composited onto white."""
    if ch == 1:
        return np.repeat(buf, 3, axis=2)
    rgb = buf[:, :, :3][:, :, ::-1]
    if ch == 4 and white_background:
        a = buf[:, :, 3:4] / 255.0
        rgb = rgb * a + 255.0 * (1.0 - a)
    return rgb


def resize_normalize_frame(pdf: pd.DataFrame, size: int = TARGET_SIZE, normalize: bool = True,
                           ui: bool = False) -> pd.DataFrame:
    out_vals, status = [], []
    for h, w, ch, data in zip(pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"]):
        if h is None or h <= 0 or data is None:
            arr = np.zeros((size, size, 3), dtype=np.float64)      # M4: undecodable -> black image
            st = "corrupted"
        else:
            buf = np.frombuffer(bytes(data), dtype=np.uint8).reshape(int(h), int(w), int(ch)).astype(np.float64)
            buf = _to_rgb(buf, int(ch), white_background=ui)
            if ui:                                                  # browser rule: centre-crop to a square
                side = min(buf.shape[0], buf.shape[1])
                top, left = (buf.shape[0] - side) // 2, (buf.shape[1] - side) // 2
                buf = buf[top:top + side, left:left + side]
            bh, bw = buf.shape[:2]
            arr = _bilinear(buf, size, size) if (bh != size or bw != size) else buf
            st = "resized" if (h != size or w != size) else "unchanged"
        x = arr / 255.0
        if normalize and not ui:
            x = (x - np.array(IMAGENET_MEAN)) / np.array(IMAGENET_STD)
        out_vals.append(x.transpose(2, 0, 1).reshape(-1).astype(np.float32))   # CHW, flattened
        status.append(st)
    return pd.DataFrame({"path": pdf["path"], "tensor": out_vals, "status": status})


def resize_normalize(images: DataFrame, size: int = TARGET_SIZE, normalize: bool = True,
                     ui: bool = False) -> DataFrame:
    """M5: ``(path, tensor array<float> of 3 x size x size, status)``.
    Default: resize then ImageNet-normalise; ``ui=True``: the browser rule --
    transparent pixels onto white, centre-crop to a square, resize, values
    in [0, 1]."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield resize_normalize_frame(pdf, size, normalize, ui)
    return images.select("path", "height", "width", "nChannels", "data").mapInPandas(
        run, "path string, tensor array<float>, status string")


def image_clean_summary(processed: DataFrame, size: int = TARGET_SIZE) -> DataFrame:
    """M6: before / after / resized / skipped / corrupted counts and the
    target size (one aggregate)."""
    st = F.col("status")
    return processed.agg(F.count(F.lit(1)).alias("before"),
                         F.sum(F.when(st != "corrupted", 1).otherwise(0)).alias("after"),
                         F.sum(F.when(st == "resized", 1).otherwise(0)).alias("resized"),
                         F.sum(F.when(st == "unchanged", 1).otherwise(0)).alias("skipped"),
                         F.sum(F.when(st == "corrupted", 1).otherwise(0)).alias("corrupted")) \
        .withColumn("target_size", F.lit(f"{size}x{size}"))


def image_preview(processed: DataFrame, n: int = 8) -> DataFrame:
    """M6 preview: the first ``n`` processed images by path (a top-n, not a
    collect of the folder)."""
    return processed.filter(F.col("status") != "corrupted").orderBy("path").limit(n).select("path", "status")


def prepare_image_split(items: DataFrame, label: str, key: str, test_size: float = 0.2,
                        seed: int = 42) -> tuple[DataFrame, list[str], DataFrame]:
    """M7: label index over the sorted class names, stratified split and
    class counts: ``(rows with label_index and split, class names, counts)``."""
    from tabwise.operators.features.target import LabelMap
    lm = LabelMap(label, "label_index").fit(items)
    indexed = lm.transform(items)
    split = split_stratified(indexed, label, key, test_size, seed)
    return split, lm.labels, class_distribution(items, label)
