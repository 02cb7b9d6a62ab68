"""Readers for JSON arrays that may be cut off in the middle."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineaudit.plans.ordered import running_sums
from lineaudit.session import stable
from lineaudit.sources.files import opened

_CHUNK = 1 << 20
#: Bytes of a file that one task reads.
RANGE = 4 << 20


def elements(path: str) -> Iterator[dict]:
    """Elements of a JSON array in order, reading ahead one chunk at a time."""
    decode = json.JSONDecoder().raw_decode
    with open(path, encoding="utf-8") as f:
        buf, more, started = "", True, False
        while True:
            buf = buf.lstrip(" \t\r\n,")
            if not started and buf.startswith("["):
                buf, started = buf[1:], True
                continue
            if started and buf.startswith("]"):
                return
            try:
                if not buf:
                    raise ValueError
                item, end = decode(buf)
                # A value that touches the end of the buffer may still go on.
                if more and end == len(buf):
                    raise ValueError
                buf = buf[end:]
                yield item
            except ValueError:
                chunk = f.read(max(_CHUNK, len(buf))) if more else ""
                if not chunk:
                    return
                buf += chunk


# -- the same from many tasks --------------------------------------------------------------

def _marks(data: bytes, escaped: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the quotes and of brackets and commas in ``data``; ``escaped`` if a backslash before it counts for its first byte."""
    b = np.frombuffer(data, np.uint8)
    at = np.arange(len(b), dtype=np.int32)
    # The last byte before each position that is no backslash; a run that reaches back before the data goes on there.
    plain = np.maximum.accumulate(np.where(b != 92, at, -1))
    before = np.concatenate([[-1], plain[:-1]]).astype(np.int64)
    run = at - 1 - before + ((before < 0) & escaped)
    quotes = np.flatnonzero((b == 34) & (run % 2 == 0))
    return quotes, np.flatnonzero((b == 91) | (b == 93) | (b == 123) | (b == 125) | (b == 44))


_STEP = np.zeros(256, np.int64)
_STEP[[91, 123]], _STEP[[93, 125]] = 1, -1


def _outside(quotes: np.ndarray, marks: np.ndarray, inside: bool) -> np.ndarray:
    """The marks that are not part of a string, if the data starts in or outside of one."""
    return marks[(np.searchsorted(quotes, marks) + inside) % 2 == 0]


def _is_escaped(f, start: int) -> bool:
    """Does an odd run of backslashes end right before ``start``?"""
    run, at = 0, start
    while at > 0:
        size = min(at, 4096)
        f.seek(at - size)
        block = f.read(size)
        kept = len(block.rstrip(b"\\"))
        run += size - kept
        if kept:
            break
        at -= size
    return run % 2 == 1


def _summary(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per range its unescaped quotes and the change of depth, if it starts outside of a string and if inside."""
    for ranges in chunks:
        found = []
        for path, start, end in zip(ranges["path"], ranges["start"], ranges["end"]):
            system, name = opened(path)
            with system.open_input_file(name) as f:
                escaped = _is_escaped(f, start)
                f.seek(start)
                data = f.read(end - start)
            quotes, marks = _marks(data, escaped)
            b = np.frombuffer(data, np.uint8)
            found.append((len(quotes), *(int(_STEP[b[_outside(quotes, marks, i)]].sum()) for i in (False, True))))
        yield ranges.assign(**dict(zip(("quotes", "outside", "inside"), zip(*found)))) if found else ranges.assign(quotes=0, outside=0, inside=0)


def _texts(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The elements whose separator (opening bracket or comma before them) lies in a range: path, offset, JSON text."""
    for ranges in chunks:
        for path, start, end, inside, depth in zip(*(ranges[c] for c in ("path", "start", "end", "in_string", "depth"))):
            system, name = opened(path)
            with system.open_input_file(name) as f:
                f.seek(0, 2)
                length = f.tell()
                escaped = _is_escaped(f, start)
                f.seek(start)
                # The element that is open, where it started, and whether new elements may still start.
                held, offset, at, rows = None, 0, start, []
                while at < length:
                    data = f.read(min(_CHUNK, (end if at < end else length) - at))
                    quotes, marks = _marks(data, escaped)
                    marks = _outside(quotes, marks, inside)
                    b = np.frombuffer(data, np.uint8)[marks]
                    after = depth + np.cumsum(_STEP[b])
                    # Separators of the outermost array: its brackets and the commas between its elements.
                    ends = ((b == 44) & (after == 1)) | ((_STEP[b] == 1) & (after == 1)) | ((_STEP[b] == -1) & (after == 0))
                    last = 0
                    for p, byte in zip(marks[ends].tolist(), b[ends].tolist()):
                        if held is not None:
                            held.append(data[last:p])
                            rows.append((path, offset, b"".join(held)))
                        held, offset, last = ([], at + p + 1, p + 1) if at < end and byte in b"[," else (None, 0, 0)
                        if held is None and at >= end:
                            break
                    if held is not None:
                        held.append(data[last:])
                    at += len(data)
                    if at >= end and held is None:
                        break
                    inside = bool((len(quotes) + inside) % 2)
                    depth = int(after[-1]) if len(after) else depth
                    run = len(data) - len(data.rstrip(b"\\"))
                    escaped = bool((run + (escaped and run == len(data))) % 2)
                if held and depth == 1 and not inside and held[-1][-1:].isspace():
                    # A cut-off file: its last element counts if it is whole, as blanks behind it show.
                    rows.append((path, offset, b"".join(held)))
            rows = [(p, o, t.decode("utf-8", "replace").strip()) for p, o, t in rows]
            rows = [r for r in rows if r[2]]
            yield pd.DataFrame(rows, columns=["_path", "_pos", "value"])


def read_arrays(spark: SparkSession, paths: str, schema: str, size: int = RANGE) -> DataFrame:
    """The elements of JSON arrays as rows of ``schema`` with ``_path`` and ``_pos``, the byte at which an element starts.

    A file is read by many tasks, each a range of bytes, on any file system that Spark and pyarrow both open. Whether a
    range starts inside a string and how deep follows from the quotes and brackets of the ranges before it: sums that one
    pass over the bytes collects per range. A second pass cuts out the elements that start in a range, reading on to the
    end of the last one. Elements behind the cut of a cut-off file are left out; one that is no JSON object, or does not
    fit the schema, is a row of nulls. Nothing may follow the array in its file.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = spark.read.format("binaryFile").load(paths).select("path", "length").filter("length > 0")
    cut = files.select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(size).cast("bigint"))).alias("start"), "length")
    cut = cut.select("path", "start", F.least(F.col("start") + size, F.col("length")).alias("end")).repartition(n, "path", "start")
    sums = stable(cut.mapInPandas(_summary, "path string, start bigint, end bigint, quotes bigint, outside bigint, inside bigint"))
    placed = running_sums(sums, ["path"], ["start"], {"_quotes": "quotes"}).drop("_quotes_total")
    placed = placed.withColumn("in_string", F.col("_quotes") % 2 == 1).withColumn("step", F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside")))
    placed = running_sums(placed.select("path", "start", "end", "in_string", "step"), ["path"], ["start"], {"depth": "step"})
    texts = placed.select("path", "start", "end", "in_string", "depth").repartition(n, "path", "start").mapInPandas(
        _texts, "_path string, _pos bigint, value string")
    return texts.select(F.from_json("value", schema).alias("_v"), "_path", "_pos").select("_v.*", "_path", "_pos")
