"""Images in another language: what lies between a recogniser's words and the text that goes over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from polyloom.functions.text import is_blank
from polyloom.operators.ocr import WORDS, text_blocks, text_lines

NO_TEXT = "No text found in image"
#: Languages whose words are joined without a space.
UNSPACED = ("ja",)


def recognised(words: DataFrame) -> DataFrame:
    """A recogniser's words (img, ord, text, confidence, left, top, right, bottom, begins_para, end_para, end_line) as ``ocr.WORDS``.

    Negative places are at the edge. A word begins a line where the recogniser says that it begins a paragraph; other lines begin behind the one that ends a line.
    """
    place = lambda c: F.greatest(F.col(c), F.lit(0)).cast("int")
    return words.select("img", "ord", "text", F.col("confidence").cast("double").alias("confidence"), place("left").alias("l"), place("top").alias("t"), place("right").alias("r"), place("bottom").alias("b"), F.col("begins_para").alias("first"), "end_line", "end_para")


def recogniser_spec(code: Column, tess_name: Column, vertical: Column, has_vertical: Column) -> Column:
    """The models that a language needs: its own and the Latin one, or that for vertical Japanese if it is there."""
    return F.when((code == "ja") & vertical & has_vertical, "jpn_vert").otherwise(F.concat(tess_name, F.lit("+eng")))


def segmentation_mode(vertical: Column) -> Column:
    return F.when(vertical, "vertical_block").otherwise("auto")


class EngineCache:
    """One recogniser in a worker, made anew if spec, direction or folder change."""

    def __init__(self, make: Callable[[str, str], object]):
        self._make, self._key, self._engine, self.made = make, None, None, 0

    def engine(self, folder: str, spec: str, mode: str) -> object:
        if self._key != (folder, spec, mode):
            self._engine, self._key, self.made = self._make(folder, spec), (folder, spec, mode), self.made + 1
        return self._engine


def recognise(images: DataFrame, load: Callable[[str, str], Callable[[bytes, int, int, str], list[dict]]], folder: str = "") -> DataFrame:
    """Words of images (img, width, height, data, spec, mode) by a recogniser that ``load(folder, spec)`` gives, with an error for an image where it fails.

    The recogniser is made once for each spec in a worker's batch: rows of one spec lie together within a partition, and nothing is shuffled.
    """
    kind = "img long, ord int, text string, confidence double, left int, top int, right int, bottom int, begins_para boolean, end_para boolean, end_line boolean, error string"

    schema = to_arrow_schema(StructType.fromDDL(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = EngineCache(load)
        for batch in batches:
            rows = []
            for img in batch.to_pylist():
                try:
                    found = cache.engine(folder, img["spec"], img["mode"])(img["data"], img["width"], img["height"], img["mode"])
                    rows += [{"img": img["img"], "ord": i, "error": None, **w} for i, w in enumerate(found)]
                except Exception as e:  # noqa: BLE001  a native recogniser's failure becomes a value
                    rows.append({"img": img["img"], "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return images.select("img", "width", "height", "data", "spec", "mode").sortWithinPartitions("spec", "mode").mapInArrow(run, kind)


def translate_blocks(blocks: DataFrame, source: str, target: str, translate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """img, block, translated, error of blocks (img, block, text).

    An image whose blocks are all blank gives an error. In the same language texts stay; else ``translate`` gets (id, text) of
    the texts that aren't blank and gives (id, translated, error), and blank ones stay as they are, in their places.
    """
    some = blocks.groupBy("img").agg(F.bool_or(~is_blank(F.coalesce("text", F.lit("")))).alias("some"))
    met = blocks.join(some, "img")
    lost = met.where("not some").select("img", "block", F.lit(None).cast("string").alias("translated"), F.lit(NO_TEXT).alias("error"))
    met = met.where("some")
    if source == target:
        return met.select("img", "block", F.col("text").alias("translated"), F.lit(None).cast("string").alias("error")).unionByName(lost)
    done = translate(met.where(~is_blank(F.col("text"))).select(F.struct("img", "block").alias("id"), "text")).select("id", F.col("translated").alias("t"), F.col("error").alias("e"))
    return merge_translated(met, done.select("id.*", "t", "e")).unionByName(lost)


def merge_translated(blocks: DataFrame, done: DataFrame) -> DataFrame:
    """img, block, translated, error: blocks (img, block, text) with what was translated (img, block, t, e) in its places."""
    met = blocks.join(done, ["img", "block"], "left")
    return met.select("img", "block", F.when(F.col("e").isNull(), F.coalesce("t", "text")).alias("translated"), F.col("e").alias("error"))


def image_texts(words: DataFrame, source: str, target: str, translate: Callable[[DataFrame], DataFrame], least: int = 60, vertical: bool = False) -> tuple[DataFrame, DataFrame]:
    """(lines, blocks with translated and error) from recognised words (``ocr.WORDS``)."""
    lines = text_lines(words, least, "" if source in UNSPACED else " ", relax=vertical)
    blocks = text_blocks(lines)
    return lines, blocks.join(translate_blocks(blocks.select("img", "block", "text"), source, target, translate), ["img", "block"])


__all__ = ["WORDS", "EngineCache", "image_texts", "merge_translated", "recognise", "recognised", "recogniser_spec", "segmentation_mode", "translate_blocks"]
