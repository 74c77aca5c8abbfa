"""Image queries.

The driver tables hold no images, so the images are made of the embeddings:
every row becomes a PNG file in the shared folder, one byte b a value (red b,
green 255 - b, blue 7 b modulo 256). A third of the rows are 4 x 4 pixels (the
first 16 values), the others 8 x 8, and every tenth file cannot be decoded. The
operators then scan, decode, resize and normalise these files. Halving 8 x 8
takes the mean of four pixels, so 1020 times a value of the tensor is a whole
number, which the twins compute from the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwise.operators.images import IMAGENET_MEAN, IMAGENET_STD, image_clean_summary, image_preview, resize_normalize
from tabwise.plans.catalog.io_q import scratch
from tabwise.registry import register
from tabwise.sources.images import load_images, scan_images, validate_images, write_images
from tabwise.sources.tables import table

SIZE = 4
_FOLDERS: dict = {}


def image_folder(spark, sf: str) -> str:
    """The folder with one image file per embedding, made once a session."""
    key = (id(spark), sf)
    if key not in _FOLDERS:
        root = scratch(spark, "images")
        small = F.col("vec_id") % 3 == 0
        value = F.when(small, F.slice("embedding", 1, 16)).otherwise(F.col("embedding"))

        def pixel(x):
            b = F.pmod(F.floor(F.abs(x.cast("double")) * 256), F.lit(256))
            return F.concat(*[F.lpad(F.hex(c), 2, "0") for c in (b, 255 - b, F.pmod(b * 7, F.lit(256)))])
        side = F.when(small, 4).otherwise(8)
        rows = table(spark, sf, "embeddings").select(
            F.concat(F.lit("c"), F.col("label"), F.lit("/img."), F.col("vec_id"), F.lit(".png")).alias("relative_path"),
            side.alias("width"), side.alias("height"), F.lit(3).alias("channels"),
            F.when(F.col("vec_id") % 10 == 3, F.encode(F.lit("not an image"), "utf-8")).otherwise(
                F.unhex(F.array_join(F.transform(value, pixel), ""))).alias("pixels"))
        write_images(rows, root)
        _FOLDERS[key] = root
    return _FOLDERS[key]


def _vec_id(path):
    return F.regexp_extract(path, r"img\.(\d+)\.png$", 1).cast("long").alias("vec_id")


@register("scan_images", """select vec_id, 'c' || label || '/img.' || vec_id || '.png' as relative_path, 'img' as label
from embeddings""")
def q_scan(spark, sf):
    return scan_images(spark, image_folder(spark, sf)).select(_vec_id("path"), "relative_path", "label")


@register("validate_images", """select sum((vec_id % 10 <> 3)::int)::bigint as valid, sum((vec_id % 10 = 3)::int)::bigint as rejected,
  count(*) as total from embeddings""")
def q_validate(spark, sf):
    return validate_images(load_images(spark, image_folder(spark, sf)))


@register("load_images", """select vec_id, case when vec_id % 10 = 3 then -1 when vec_id % 3 = 0 then 4 else 8 end as height,
  case when vec_id % 10 = 3 then -1 when vec_id % 3 = 0 then 4 else 8 end as width,
  case when vec_id % 10 = 3 then -1 else 3 end as channels,
  case when vec_id % 10 = 3 then 0 when vec_id % 3 = 0 then 48 else 192 end as n_bytes from embeddings""")
def q_load(spark, sf):
    return load_images(spark, image_folder(spark, sf)).select(
        _vec_id("path"), "height", "width", F.col("nChannels").alias("channels"),
        F.coalesce(F.octet_length("data"), F.lit(0)).alias("n_bytes"))


# place of a pixel in the 4 x 4 tensor plane, and its weight in 1020ths
_PIXELS = """px as (select vec_id, i, (floor(abs(cast(embedding[i + 1] as double)) * 256)::bigint % 256) as b
  from embeddings, range(64) t(i) where vec_id % 10 <> 3 and (vec_id % 3 <> 0 or i < 16)),
cells as (select vec_id, case when vec_id % 3 = 0 then i else (i // 16) * 4 + (i % 8) // 2 end as place,
  case when vec_id % 3 = 0 then 4 else 1 end as w, b from px),
values_ as (select vec_id, place + 1 as place, w * b as v from cells
  union all select vec_id, place + 17, w * (255 - b) from cells
  union all select vec_id, place + 33, w * (b * 7 % 256) from cells)"""
_TENSORS = f"""with {_PIXELS},
sums as (select vec_id, sum(v)::bigint as total, sum(place * v)::bigint as weighted from values_ group by vec_id)
select vec_id, case when vec_id % 10 = 3 then 'corrupted' when vec_id % 3 = 0 then 'unchanged' else 'resized' end as status,
  48 as n_values, coalesce(total, 0) as total, coalesce(weighted, 0) as weighted
from embeddings left join sums using (vec_id)"""


def _tensor_sums(tensors, normalized: bool):
    """Sum, and sum weighted by place, of the tensor's values in 1020ths."""
    mean, std = ([F.lit(c) for c in v] for v in (IMAGENET_MEAN, IMAGENET_STD))
    plane = lambda v, i: F.get(F.array(*v), F.floor(i / (SIZE * SIZE)).cast("int"))

    def whole(x, i):
        x = x.cast("double")
        return F.round((x * plane(std, i) + plane(mean, i) if normalized else x) * 1020).cast("long")
    values = F.transform("tensor", whole)
    add = lambda a, x: a + x
    return tensors.select(
        _vec_id("path"), "status", F.size("tensor").alias("n_values"),
        F.aggregate(values, F.lit(0).cast("long"), add).alias("total"),
        F.aggregate(F.transform(values, lambda x, i: x * (i + 1)), F.lit(0).cast("long"), add).alias("weighted"))


@register("resize_normalize", _TENSORS)
def q_tensors(spark, sf):
    """An undecodable file is a black image, normalised like the others."""
    return _tensor_sums(resize_normalize(load_images(spark, image_folder(spark, sf)), SIZE), True)


@register("resize_normalize_ui", _TENSORS)
def q_tensors_ui(spark, sf):
    return _tensor_sums(resize_normalize(load_images(spark, image_folder(spark, sf)), SIZE, ui=True), False)


@register("image_clean_summary", f"""select count(*) as before, sum((vec_id % 10 <> 3)::int)::bigint as after,
  sum((vec_id % 10 <> 3 and vec_id % 3 <> 0)::int)::bigint as resized,
  sum((vec_id % 10 <> 3 and vec_id % 3 = 0)::int)::bigint as skipped,
  sum((vec_id % 10 = 3)::int)::bigint as corrupted, '{SIZE}x{SIZE}' as target_size from embeddings""")
def q_summary(spark, sf):
    return image_clean_summary(resize_normalize(load_images(spark, image_folder(spark, sf)), SIZE), SIZE)


@register("image_preview", """select vec_id, case when vec_id % 3 = 0 then 'unchanged' else 'resized' end as status from embeddings
where vec_id % 10 <> 3 order by 'c' || label || '/img.' || vec_id || '.png' limit 8""")
def q_preview(spark, sf):
    out = image_preview(resize_normalize(load_images(spark, image_folder(spark, sf)), SIZE))
    return out.select(_vec_id("path"), "status")
