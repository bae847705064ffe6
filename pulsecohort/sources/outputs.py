"""Where a run reads and writes: companion folders, free names, input plans and archives.

Paths are text with ``/``; everything but the plan's kind is an expression or a
grouped operator, so that a listing of any length stays a DataFrame.
"""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsecohort.sources import files

#: The applications that have a folder beside a data set, and the kinds of output in it.
APPS = ("HD", "DV", "EF", "AE")
KINDS = ("h5", "png", "html")
ACQUISITIONS = (".h5", ".hdf5")

_HOLO = r"(?i)^(.*/)?([^/]+)\.holo$"
_APP = rf"^(.*/)?[^/]+_(?:{'|'.join(APPS)})(?:/.*)?$"


def dataset_root(path: Column) -> Column:
    """Folder of the data set: beside a .holo file the folder of its name, else what holds the innermost folder of an application; null if neither."""
    beside = F.concat(F.regexp_extract(path, _HOLO, 1), F.regexp_extract(path, _HOLO, 2))
    held = F.regexp_replace(F.regexp_extract(path, _APP, 1), "(?<=.)/$", "")
    return F.when(path.rlike(_HOLO), beside).when(path.rlike(_APP), F.when(held == "", ".").otherwise(held))


def stem(path: Column) -> Column:
    """Name of the data set; without one null."""
    return F.nullif(F.nullif(F.regexp_extract(dataset_root(path), "([^/]*)$", 1), F.lit("")), F.lit("."))


def app_folder(path: Column, app: str) -> Column:
    """The folder of an application, such as <root>/<stem>_AE."""
    if app.strip().upper().removeprefix("_") not in APPS:
        raise ValueError(f"no application {app!r}, one of {', '.join(APPS)}")
    return F.concat(dataset_root(path), F.lit("/"), stem(path), F.lit("_" + app.strip().upper().removeprefix("_")))


def companion_folder(path: Column, app: str, kind: str) -> Column:
    return F.concat(app_folder(path, app), F.lit("/" + kind.strip().lower()))


def output_name(path: Column) -> Column:
    """File that a single input gives: its data set's name, else its own without the ending and _EF, and _AE.h5."""
    own = F.regexp_replace(F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", ""), "(?i)_ef$", "")
    return F.concat(F.coalesce(stem(path), F.nullif(own, F.lit("")), F.lit("output")), F.lit("_AE.h5"))


def free_names(rows: DataFrame, group: str, name: str, position: str, out: str = "free_name") -> DataFrame:
    """group, position, name and the name under which it is appended: itself, else the first free of _1, _2 and so on, in order of position.

    A group is the trees of one file, so it is held as one array. A null name counts as "tree".
    """
    given = F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), F.coalesce(name, F.lit("tree")).alias("n"))))

    def place(taken, item):
        used = F.transform(taken, lambda t: t["f"])
        tries = F.concat(F.array(item["n"]), F.transform(F.sequence(F.lit(1), F.size(taken) + 1), lambda i: F.concat(item["n"], F.lit("_"), i.cast("string"))))
        free = F.get(F.filter(tries, lambda t: ~F.array_contains(used, t)), F.lit(0))
        return F.concat(taken, F.array(F.struct(item["p"].alias("p"), item["n"].alias("n"), free.alias("f"))))

    kind = dict(rows.dtypes)[position]
    empty = F.array().cast(f"array<struct<p:{kind},n:string,f:string>>")
    named = rows.groupBy(group).agg(F.aggregate(given, empty, place).alias("_t")).select(group, F.explode("_t").alias("_t"))
    return named.select(group, F.col("_t.p").alias(position), F.col("_t.n").alias(name), F.col("_t.f").alias(out))


def input_plan(spark: SparkSession, paths: list[str]) -> tuple[str, DataFrame]:
    """Kind of a selection (file, folder, zip) and its acquisitions as rows of path.

    One path may be an acquisition, an archive or a folder; several must all be acquisitions. None gives an empty folder.
    """
    ends = [p.lower().endswith(ACQUISITIONS) for p in paths]
    if len(paths) > 1 and not all(ends):
        raise ValueError("several inputs must be .h5 or .hdf5 files: " + ", ".join(p for p, e in zip(paths, ends) if not e))
    if not paths or all(ends):
        return ("file" if paths else "folder"), spark.createDataFrame([(p,) for p in paths], "path string")
    one = paths[0].rstrip("/")
    if one.lower().endswith(".zip"):
        folder, _, name = one.rpartition("/")
        members = files.archive_members(spark, folder or ".", name)
        return "zip", members.where(files.is_acquisition(F.col("member"))).select(F.col("member").alias("path"))
    listed = files.list_files(spark, one)
    return "folder", listed.where(files.is_acquisition(F.col("path"))).select("path")


def archives(rows: DataFrame, key: str, name: str = "path", content: str = "content") -> DataFrame:
    """key, members and archive: one ZIP of each key's rows, in order of name, lightly compressed; a null content is an empty member.

    An archive is one binary value, so a key must stay under 2 GB; rows are sorted by Spark and written as they come.
    """

    def run(batches):
        at, buffer, out, n = None, None, None, 0

        def done():
            out.close()
            return pa.RecordBatch.from_pydict({key: [at], "members": [n], "archive": [buffer.getvalue()]}, schema=pa.schema([(key, pa.string()), ("members", pa.int64()), ("archive", pa.binary())]))

        for batch in batches:
            for k, member, data in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or k != at:
                    if out is not None:
                        yield done()
                    at, buffer, n = k, io.BytesIO(), 0
                    out = zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                out.writestr(zipfile.ZipInfo(member), data or b"", zipfile.ZIP_DEFLATED, 1)
                n += 1
        if out is not None:
            yield done()

    chosen = rows.select(F.col(key).cast("string").alias(key), name, content)
    return chosen.repartition(key).sortWithinPartitions(key, name).mapInArrow(run, f"`{key}` string, members long, archive binary")
