"""Files as tables: folders, archives, lists of paths, metric trees; cohorts from paths; aliases; sinks."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ACQUISITION_PATTERN = r"\.(h5|hdf5)$"


def is_acquisition(path: Column) -> Column:
    return F.lower(path).rlike(ACQUISITION_PATTERN)


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, length and modification time of the files below a folder; the content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).select("path", "length", "modificationTime")


def safe_member(name: Column) -> Column:
    """A member that stays inside its archive."""
    return ~(name.rlike(r"^([/\\]|[A-Za-z]:)") | name.rlike(r"(^|[/\\])\.\.([/\\]|$)") | name.endswith("/"))


def archive_members(spark: SparkSession, folder: str, glob: str = "*.zip", content: bool = False) -> DataFrame:
    """(archive, member, size, content) of every archive below a folder, in name order; members outside their archive are left out.

    An archive is read whole by one task; members are given back one by one.
    """

    def run(batches):
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for info in sorted(z.infolist(), key=lambda i: i.filename):
                        body = z.read(info) if content and not info.is_dir() else None
                        yield pa.RecordBatch.from_pydict({"archive": [path], "member": [info.filename], "size": [info.file_size], "content": pa.array([body], pa.binary())})

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).select("path", "content")
    return raw.mapInArrow(run, "archive string, member string, size long, content binary").where(safe_member(F.col("member")))


def path_list(spark: SparkSession, path: str, suffix: str = ".holo") -> tuple[DataFrame, DataFrame]:
    """Paths named in a text file, and the lines that are none (quarantined with a message); blank lines and # comments are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line != '' and not startswith(line, '#')")
    good = F.lower("line").endswith(suffix)
    return lines.where(good).select(F.col("line").alias("path")).distinct(), lines.where(~good).select("line", F.lit(f"does not end in {suffix}").alias("message"))


def cohort_of(path: Column) -> Column:
    """First folder of a relative path, a leading h5/ skipped; ``all`` for a file at the root."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: p != "")
    rest = F.when(F.lower(F.get(parts, F.lit(0))) == "h5", F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1)))).otherwise(parts)
    return F.when(F.size(rest) >= 2, F.get(rest, F.lit(0))).otherwise("all")


def is_control(cohort: Column, rule: str = "substring") -> Column:
    """Three rules: a substring or short name, anchored patterns, or hints."""
    low = F.lower(cohort)
    return {
        "substring": low.contains("control") | low.isin("ctrl", "ctl", "controls"),
        "anchored": low.rlike(r"^(control|controle|contrôle|ctrl|ctl)s?([\s_-]|$)"),
        "hints": low.rlike("control|ctrl|healthy|sain|temoin|témoin|after"),
    }[rule]


def order_cohorts(df: DataFrame, rule: str = "substring") -> DataFrame:
    """Cohorts by name, the control last."""
    return df.orderBy(is_control(F.col("cohort"), rule), "cohort")


def safe_key(name: Column) -> Column:
    """Lower case, everything but letters and digits to single underscores, none at the ends; item if nothing is left."""
    key = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(key == "", "item").otherwise(key)


def companion(files: DataFrame, stem: str = "stem") -> DataFrame:
    """One companion a stem: the exact name first, then one below h5/, then by path."""
    order = Window.partitionBy(stem).orderBy(F.desc("exact"), F.desc(F.lower("path").contains("/h5/")), F.lower("path"))
    return files.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def resolve_aliases(datasets: DataFrame, aliases: DataFrame) -> DataFrame:
    """Per acquisition and signal the dataset of the first alias that exists; ``aliases`` is (signal, path, priority), a fixed few rows."""
    found = datasets.join(F.broadcast(aliases), "path")
    best = F.min_by(F.struct("path", "value"), F.struct("priority", "path"))
    return found.groupBy("acq", "signal").agg(best.alias("b")).select("acq", "signal", "b.path", "b.value")


def first_group(datasets: DataFrame, order: list[str], ndim: int) -> DataFrame:
    """The first group of ``order`` that an acquisition has, and then only if its array has ``ndim`` axes: a wrong one does not fall through."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("group"))
    best = datasets.where(rank > 0).groupBy("acq", "name").agg(F.min(rank).alias("_b"))
    return datasets.join(best, ["acq", "name"]).where((rank == F.col("_b")) & (F.col("ndim") == ndim)).drop("_b")


def missing_paths(datasets: DataFrame, required: DataFrame) -> DataFrame:
    """(acq, path) that are required and not there."""
    need = datasets.select("acq").distinct().withColumn("_k", F.lit(0)).join(F.broadcast(required.agg(F.collect_set("path").alias("paths")).withColumn("_k", F.lit(0))), "_k").select("acq", F.explode("paths").alias("path"))
    return need.join(datasets.select("acq", "path"), ["acq", "path"], "left_anti")


def read_or_default(keys: DataFrame, datasets: DataFrame, key: str, value: str, default: float) -> DataFrame:
    """Every key with its value, or the default where there is none."""
    return keys.select(key).join(datasets.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def ordered_distinct(rows: DataFrame, name: str, position: str) -> DataFrame:
    """The first row of each name, by position."""
    others = [c for c in rows.columns if c != name]
    return rows.groupBy(name).agg(F.min_by(F.struct(*others), F.col(position)).alias("r")).select(name, "r.*")


def output_or_input(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """By position the processed file if it is compatible, else the input if that is, else nothing: (position, path, side)."""
    o = outputs.where("compatible").select("position", F.col("path").alias("_out"))
    i = inputs.where("compatible").select("position", F.col("path").alias("_in"))
    return o.join(i, "position", "full").select("position", F.coalesce("_out", "_in").alias("path"), F.when(F.col("_out").isNull(), "input").otherwise("output").alias("side"))


def name_list(text: str) -> list[str]:
    """Names in a text: a bracketed list, or one a line; blank lines and # comments are skipped, a repeated name counts once, in order."""
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        parts = text[1:-1].replace(",", " ").split()
        names = [p.strip("'\"") for p in parts]
    else:
        names = [x.strip() for x in text.splitlines()]
    return list(dict.fromkeys(n for n in names if n and not n.startswith("#")))


def version_stamp(upstream: Column, name: str, version: str) -> Column:
    """Upstream versions (JSON text) with ours beside them."""
    old = F.coalesce(F.from_json(upstream, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.to_json(F.map_concat(F.map_filter(old, lambda k, v: k != name), F.create_map(F.lit(name), F.lit(version))))


def write_metrics(rows: DataFrame, path: str, mode: str = "append") -> None:
    """The long metric table, a folder a pipeline; overwriting replaces only the pipelines that are written."""
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("pipeline").parquet(path)


def metric_paths(rows: DataFrame) -> DataFrame:
    return rows.select("pipeline", "path").distinct()


def file_order(name: Column) -> Column:
    """Date of six digits, then the index before _HD, for sorting files by acquisition."""
    return F.struct(F.regexp_extract(name, r"(\d{6})", 1).alias("date"), F.coalesce(F.try_element_at(F.regexp_extract_all(name, F.lit(r"_(\d+)_HD"), F.lit(1)), F.lit(1)).cast("int"), F.lit(0)).alias("index"))


def read_acquisitions(spark: SparkSession, folder: str) -> DataFrame:
    """Signals of HDF5 files as (path, dataset, values); needs h5py on the executors and says so where it is missing."""

    def run(batches):
        try:
            import h5py
        except ImportError as e:
            raise ImportError("reading HDF5 needs h5py on every executor; give Parquet in the waveform schema instead") from e
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with h5py.File(io.BytesIO(data), "r") as f:
                    found = []
                    f.visititems(lambda name, x, found=found: found.append((name, x[()])) if hasattr(x, "shape") and x.dtype.kind in "fiu" else None)
                    for name, x in found:
                        yield pa.RecordBatch.from_pydict({"path": [path], "dataset": [name], "shape": pa.array([list(x.shape)], pa.list_(pa.int64())), "values": pa.array([x.ravel().astype(float).tolist()], pa.list_(pa.float64()))})

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(is_acquisition(F.col("path"))).select("path", "content")
    return raw.mapInArrow(run, "path string, dataset string, shape array<long>, values array<double>")
