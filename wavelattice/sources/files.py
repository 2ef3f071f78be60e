"""WAV files, dataset folders, annotations, catalogs and hashes."""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BIT_DEPTH = 16
FULL_SCALE = float(1 << (BIT_DEPTH - 1))


def decode_wav(content: bytes, offset: float = 0.0, duration: float | None = None) -> tuple[int, np.ndarray]:
    """(rate, samples by channel in -1..1) of PCM content; offset and duration are seconds."""
    if offset < 0 or (duration is not None and duration < 0):
        raise ValueError("offset and duration are zero or more")
    with wave.open(io.BytesIO(content)) as f:
        rate, channels, width, total = f.getframerate(), f.getnchannels(), f.getsampwidth(), f.getnframes()
        first = int(offset * rate)
        if first > total:
            raise ValueError("offset is past the end")
        f.setpos(first)
        raw = f.readframes(total - first if duration is None else int(duration * rate))
    if width == 3:
        wide = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        data = (np.pad(wide, ((0, 0), (1, 0))).copy().view("<i4").ravel() >> 8) / float(1 << 23)
    elif width == 1:
        data = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    else:
        data = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]) / float(1 << (8 * width - 1))
    return rate, data.reshape(-1, channels).T


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    """16-bit PCM; values are truncated toward zero and clipped at full scale."""
    pcm = np.clip(np.trunc(np.asarray(samples, float) * FULL_SCALE), -FULL_SCALE, FULL_SCALE - 1).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(len(pcm))
        f.setsampwidth(2)
        f.setframerate(int(rate))
        f.writeframes(np.ascontiguousarray(pcm.T).tobytes())
    return out.getvalue()


def read_wav(spark: SparkSession, path: str, offset: float = 0.0, duration: float | None = None, glob: str = "*.wav") -> DataFrame:
    """Packed signals: path, label (folder), item (file name), sr, x array<array<double>>. Decoded in Arrow batches."""

    def run(batches):
        for batch in batches:
            made = [decode_wav(c.as_py(), offset, duration) for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r for r, _ in made], pa.int32()), pa.array([[list(map(float, ch)) for ch in d] for _, d in made], pa.list_(pa.list_(pa.float64())))], names=["path", "sr", "x"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    packed = files.select("path", "content").mapInArrow(run, "path string, sr int, x array<array<double>>")
    return packed.select("path", F.element_at(F.split("path", "/"), -2).alias("label"), basename("path").alias("item"), "sr", "x")


def wav_bytes(packed: DataFrame) -> DataFrame:
    """item, content: WAV bytes of packed signals (item, sr, x)."""

    def run(batches):
        for batch in batches:
            made = [encode_wav(np.array(x.as_py(), float).reshape(len(x.as_py()), -1), r.as_py()) for r, x in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["item", "content"])

    return packed.select("item", "sr", "x").mapInArrow(run, "item string, content binary")


def unpack(packed: DataFrame) -> DataFrame:
    """Long signals of packed ones."""
    rows = packed.select(*[c for c in packed.columns if c != "x"], F.posexplode("x").alias("ch", "_c"))
    return rows.select(*[c for c in rows.columns if c != "_c"], F.posexplode("_c").alias("n", "x")).withColumn("n", F.col("n").cast("bigint"))


def pack(signals: DataFrame, *keys: str) -> DataFrame:
    """Packed signals (keys, x[channel][sample]) of long ones."""
    by_channel = signals.groupBy(*keys, "ch").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda s: s["x"]).alias("c"))
    return by_channel.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("ch", "c"))), lambda s: s["c"]).alias("x"))


def from_integers(column: Column) -> Column:
    """Samples of an integer array, as floats of 16-bit scale."""
    return column / F.lit(FULL_SCALE)


def basename(path) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def mix_source_folder(files: DataFrame, mix_folder: str = "mix", make_mix: bool = False) -> DataFrame:
    """item, label, path of the sources of every mix (or of every source file, if the mix is to be made) matched by file name."""
    sources = files.where(F.col("label") != mix_folder)
    if make_mix:
        return sources.select("item", "label", "path")
    mixes = files.where(F.col("label") == mix_folder).select("item", F.col("path").alias("mix_path"))
    return mixes.join(sources.select("item", "label", "path"), "item", "left")


def suffixed_labels(events: DataFrame) -> DataFrame:
    """labels array -> array of label::count, count being how many earlier labels contain this one."""
    return events.withColumn(
        "labels",
        F.transform("labels", lambda x, i: F.concat_ws("::", x, F.size(F.filter(F.slice("labels", F.lit(1), i), lambda y: y.contains(x))).cast("string"))),
    )


def file_hashes(files: DataFrame) -> DataFrame:
    return files.withColumn("file_hash", F.sha2("content", 256))


def directory_hash(files: DataFrame) -> DataFrame:
    """directory, directory_hash: digest of the sorted file digests laid end to end. Digests only, 64 characters a file."""
    return files.groupBy("directory").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("file_hash")), ""), 256).alias("directory_hash"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    schema = "file_name string, file_hash string, file_size string, file_size_bytes long, file_length_seconds double, file_description string, audio_attributes string, for_class string, visible boolean, date_added string, date_modified string"
    return spark.read.schema(schema).json(path, multiLine=True)


def catalog_entry(catalog: DataFrame, file_name: str) -> DataFrame:
    """The first entry of that name; no row if there is none."""
    return catalog.where(F.col("file_name") == file_name).limit(1)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """source, file, metric, idx, value of score files {source: {metric: [values]}}; bookkeeping keys are skipped."""
    text = spark.read.text(path, wholetext=True).select(basename(F.input_file_name()).alias("file"), F.from_json("value", "map<string,string>").alias("m"))
    by_source = text.select("file", F.explode("m").alias("source", "body")).where(~F.col("source").isin("combination", "permutation", "metadata"))
    metrics = by_source.select("file", "source", F.explode(F.from_json("body", "map<string,array<double>>")).alias("metric", "values"))
    return metrics.select("source", "file", "metric", F.posexplode("values").alias("idx", "value"))
