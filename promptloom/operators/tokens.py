"""Sizes of prompts and images: tokens, pixels, and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Side of a vision patch in pixels, and tokens of a 336-pixel image.
PATCH = 14
IMAGE_TOKENS = 576


def text_tokens(text: Column) -> Column:
    """Words and punctuation marks: a tokenizer stand-in that runs in the JVM."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]"))


def image_tokens(width: Column, height: Column, patch: int = PATCH) -> Column:
    """Patches that cover the image; null for images without a size."""
    return (F.ceil(width / patch) * F.ceil(height / patch)).cast("long")


def png_size(data: Column) -> tuple[Column, Column]:
    """Width and height from a PNG header; null for other bytes."""
    head = F.hex(F.substring(data, 1, 24))
    number = lambda at: F.conv(F.substring(head, at, 8), 16, 10).cast("long")
    is_png = head.startswith("89504E470D0A1A0A") & (F.length(head) == 48)
    return F.when(is_png, number(33)), F.when(is_png, number(41))


def token_counts(df: DataFrame, row_id: str, text: Column, width: Column | None = None, height: Column | None = None) -> DataFrame:
    """row id, image_tokens, text_tokens, total_tokens, total_pixels, image_width,
    image_height; rows without an image have 0 for what concerns it."""
    w, h = (F.lit(0) if width is None else width).cast("long"), (F.lit(0) if height is None else height).cast("long")
    image, words = F.coalesce(image_tokens(w, h), F.lit(0)), text_tokens(text).cast("long")
    return df.select(row_id, image.alias("image_tokens"), words.alias("text_tokens"), (image + words).alias("total_tokens"), F.coalesce(w * h, F.lit(0)).alias("total_pixels"), F.coalesce(w, F.lit(0)).alias("image_width"), F.coalesce(h, F.lit(0)).alias("image_height"))
