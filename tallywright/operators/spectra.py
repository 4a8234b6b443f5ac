"""Filter banks over samples that are rows, so that no recording has to fit a task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions import audio


def frames(df: DataFrame, keys: list[str], place: str, sample: str, length: int, shift: int) -> DataFrame:
    """keys, frame and samples, an array: the frames of length samples that begin at every multiple of shift.

    df: a row for each sample, place counting from 0. A sample goes to each frame that it lies in, so a long recording is
    spread over its frames. Frames that reach beyond the recording, or in which a sample is missing, are left out.
    """
    at = F.col(place)
    first = F.greatest(F.lit(0), F.floor((at - length + shift) / shift))
    own = df.filter(at.isNotNull() & F.col(sample).isNotNull() & (at >= 0))
    if shift > length:  # between two frames there are samples of none
        own = own.filter(F.pmod(at, F.lit(shift)) < length)
    own = own.select(*keys, F.explode(F.sequence(first, F.floor(at / shift))).alias("frame"), at.cast("long").alias("_at"), F.col(sample).cast("double").alias("_x"))
    held = own.groupBy(*keys, "frame").agg(F.array_sort(F.collect_list(F.struct("_at", "_x"))).alias("_held"))
    return held.filter(F.size("_held") == length).select(*keys, "frame", F.col("_held._x").alias("samples"))


def filter_bank(df: DataFrame, keys: list[str], place: str, sample: str, rate: int, bands: int = 128, length_ms: int = 25, shift_ms: int = 10) -> DataFrame:
    """keys, frame, band, energy: the log energies of frames of length_ms every shift_ms, as speech toolkits define them.

    See frames for df and audio.kaldi_energies for the energies. Samples are taken as they are: scale them before.
    """
    length, shift = rate * length_ms // 1000, rate * shift_ms // 1000
    cut = frames(df, keys, place, sample, length, shift)
    names = [*keys, "frame"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("samples").flatten().to_numpy().reshape(batch.num_rows, length)
                out = audio.kaldi_energies(x, rate, bands)
                lists = pa.ListArray.from_arrays(pa.array(range(0, out.size + 1, bands), pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), lists], [*names, "energies"])

    form = ", ".join(f"`{n}` {cut.schema[n].dataType.simpleString()}" for n in names)
    return cut.mapInArrow(run, f"{form}, energies array<double>").select(*names, F.posexplode("energies").alias("band", "energy"))
