"""Rule-based quality: counts over words and lines, and bands of zstandard ratios.

A text is rejected when it is too short, when too many of its words lie in
repeated 8-word windows, or when it compresses too well (repetitive) or too
badly (noise). The ratio depends on length, so the limits of whole documents are
per band of byte length. Fixed chunks share one length and so one band; they
catch long documents of which a half is junk. The last chunk ends with the text
and overlaps the one before, so every byte is in one.

Null texts count as empty. Repeated rows and null ids give one result row each.
Extra columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernels import covered

SCHEMA = """doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,
    base_failed boolean, kept boolean, zstd_ratio double, n_chunks long, n_bad_chunks long"""
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Bands:
    """Accepted raw/compressed ratios.

    ``whole`` lists (bytes from, least, most), ascending; shorter texts than the
    first entry are not judged. ``chunk`` holds for pieces of ``chunk_bytes``;
    a text fails when ``bad_share`` or more of its chunks are outside.
    """

    whole: tuple = (
        (256, 1.10, 2.40), (512, 1.15, 2.50), (1024, 1.20, 2.60), (2048, 1.25, 2.70), (4096, 1.25, 2.80),
        (8192, 1.25, 2.90), (16384, 1.25, 3.00), (65536, 1.25, 3.20), (1 << 20, 1.25, 3.50),
    )
    chunk: tuple = (1.20, 2.70)
    chunk_bytes: int = 2048
    bad_share: float = 0.5
    level: int = 3

    def limits(self, n: int):
        found = None
        for start, least, most in self.whole:
            if n >= start:
                found = (least, most)
        return found


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a window that occurs twice or more in this text."""
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    step = 1
    while step < window:  # ids of windows twice as long, exact: pairs of ids are renumbered
        pairs = ids[:-step] * n + ids[step:]
        ids = np.unique(pairs, return_inverse=True)[1]
        step *= 2
    often = np.bincount(ids)[ids] > 1
    return int(covered(np.flatnonzero(often), window, n).sum())


def repeated_lines(data: bytes) -> int:
    lines = [x for x in data.split(b"\n") if x.strip(SPACES.encode())]
    return len(lines) - len(set(lines))


def measure(text: str, bands: Bands, packer) -> tuple:
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(data.count(c) for c in SYMBOLS)
    n_repeat = repeated_words(words)
    failed = len(words) < 20 or 100 * n_repeat > 30 * len(words)
    limits, ratio, n_chunks, bad = bands.limits(len(data)), None, 0, 0
    verdict = True
    if data:
        ratio = len(data) / len(packer.compress(data))
    if limits:
        verdict = limits[0] <= ratio <= limits[1]
    size = bands.chunk_bytes
    if len(data) > size:  # one chunk alone would repeat the whole
        for at in [*range(0, len(data) - size, size), len(data) - size]:
            n_chunks += 1
            bad += not bands.chunk[0] <= size / len(packer.compress(data[at:at + size])) <= bands.chunk[1]
        verdict = verdict and bad < bands.bad_share * n_chunks
    return (len(words), chars, symbols, repeated_lines(data), n_repeat, failed, verdict and not failed,
            ratio, n_chunks, bad)


def judge(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One row per input row with the counts, ``base_failed`` and ``kept``. One pass, no shuffle."""

    def run(batches):
        import zstandard

        packer = zstandard.ZstdCompressor(level=bands.level)
        names = [c.split()[0] for c in SCHEMA.split(",")][1:]
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
        for batch in batches:
            rows = [measure(t.as_py(), bands, packer) for t in batch.column("text")]
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", *names])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.mapInArrow(run, SCHEMA)
