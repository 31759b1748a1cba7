"""FITS files: headers of 80-character cards and big-endian images.

Only the primary image is read. Bytes come through Spark's own file source, so
any store it can open will do; each file is decoded inside a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: the size of a block and of a card, and the kinds of numbers.
BLOCK, CARD = 2880, 80
KINDS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def card_value(card: str) -> str | None:
    """The value in a card, without quotes; null in a card without one."""
    if card[8:10] != "= ":
        return None
    body = card[10:].lstrip()
    if not body.startswith("'"):
        return body.split("/", 1)[0].strip()
    out, k = "", 1
    while k < len(body):
        if body[k] == "'":
            if body[k + 1 : k + 2] != "'":
                break
            k += 1
        out += body[k]
        k += 1
    return out.rstrip()


def header_of(content: bytes) -> tuple[dict[str, str], int]:
    """The cards of the primary header by keyword (the last one of a keyword
    counts), and where its data begin."""
    cards: dict[str, str] = {}
    for at in range(0, len(content) - CARD + 1, CARD):
        card = content[at : at + CARD].decode("latin-1")
        keyword = card[:8].rstrip()
        if keyword == "END":
            return cards, (at // BLOCK + 1) * BLOCK
        value = card_value(card)
        if keyword and value is not None:
            cards[keyword] = value
    raise ValueError("a header without an end")


def image_of(content: bytes) -> tuple[dict[str, str], list[int], np.ndarray]:
    """Header, shape (slowest axis first) and physical values of the primary image."""
    header, start = header_of(content)
    shape = [int(header[f"NAXIS{k}"]) for k in range(int(header.get("NAXIS", 0)), 0, -1)]
    if not shape:
        return header, [], np.empty(0)
    raw = np.frombuffer(content, KINDS[int(header["BITPIX"])], int(np.prod(shape)), start)
    return header, shape, raw * float(header.get("BSCALE", 1)) + float(header.get("BZERO", 0))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{fits,fit,fts}").load(path)


def fits_headers(spark: SparkSession, path: str, most_bytes: int = 40 * BLOCK) -> DataFrame:
    """(path, header map) of all files under a folder; headers over ``most_bytes``
    are read whole, shorter ones without their images."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "header": [header_of(c)[0] for c in pdf["head"]]})

    ended = F.locate("END" + " " * 77, F.decode(F.substring("content", 1, most_bytes), "ISO-8859-1")) > 0
    head = F.when(ended, F.substring("content", 1, most_bytes)).otherwise(F.col("content"))
    return _files(spark, path).select("path", head.alias("head")).mapInPandas(run, "path string, header map<string,string>")


def fits_frames(spark: SparkSession, path: str) -> DataFrame:
    """(path, header, date_obs, jd, height, width, pixels) of all images under a
    folder; the planes of a cube are one under the other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                header, shape, values = image_of(content)
                width = shape[-1] if shape else 0
                rows.append((name, header, len(values) // width if width else 0, width, values))
            yield pd.DataFrame(rows, columns=["path", "header", "height", "width", "pixels"])

    frames = _files(spark, path).select("path", "content").mapInPandas(run, "path string, header map<string,string>, height int, width int, pixels array<double>")
    return frames.select("path", "header", F.try_element_at("header", F.lit("DATE-OBS")).alias("date_obs"), header_jd(F.col("header")).alias("jd"), "height", "width", "pixels")


def header_jd(header: Column) -> Column:
    """The Julian date of a header: its own, else that of DATE-OBS, where a month
    of 00 counts as 01; null if neither can be read."""
    stamp = F.replace(F.try_element_at(header, F.lit("DATE-OBS")), F.lit("-00-"), F.lit("-01-"))
    return F.coalesce(F.try_element_at(header, F.lit("JD")).try_cast("double"), F.unix_micros(stamp.try_cast("timestamp")) / 86400e6 + 2440587.5)


def frame_sizes(frames: DataFrame, folder: str) -> DataFrame:
    """(folder, frames, height, width) of the frames of each folder."""
    return frames.groupBy(folder).agg(F.count(F.lit(1)).alias("frames"), F.max("height").alias("height"), F.max("width").alias("width"))


def fits_bytes(image: np.ndarray, header: dict[str, object]) -> bytes:
    """A file of one image as doubles, with the given header values."""
    shape = image.shape
    values = {"SIMPLE": True, "BITPIX": -64, "NAXIS": len(shape)} | {f"NAXIS{k + 1}": n for k, n in enumerate(reversed(shape))} | header
    text = lambda v: f"{'T' if v else 'F':>20}" if isinstance(v, bool) else f"{v:>20}" if isinstance(v, int | float) else "'" + str(v).replace("'", "''").ljust(8) + "'"
    cards = [f"{k:<8}= {text(v)}".ljust(CARD)[:CARD] for k, v in values.items()] + ["END".ljust(CARD)]
    head = "".join(cards).encode("latin-1")
    data = np.ascontiguousarray(image, ">f8").tobytes()
    return head + b" " * (-len(head) % BLOCK) + data + b"\0" * (-len(data) % BLOCK)


def write_images(frames: DataFrame, path: str, name: str = "name") -> DataFrame:
    """Write each frame (name, height, width, pixels) as a file of its own, unless
    there is one; gives (name, written). For folders that every executor sees."""
    from pathlib import Path

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = []
            for row in pdf.to_dict("records"):
                file = Path(path) / f"{row[name]}.fits"
                fresh = not file.exists()
                if fresh:
                    file.parent.mkdir(parents=True, exist_ok=True)
                    part = file.with_suffix(".part")
                    part.write_bytes(fits_bytes(np.asarray(row["pixels"], float).reshape(row["height"], row["width"]), {"FRAME": str(row[name])}))
                    part.replace(file)
                done.append((row[name], fresh))
            yield pd.DataFrame(done, columns=[name, "written"])

    return frames.select(name, "height", "width", "pixels").mapInPandas(run, f"`{name}` string, written boolean")
