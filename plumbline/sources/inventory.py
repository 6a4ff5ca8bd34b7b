"""What lies under a path: files, bytes, and the format they share."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of compressions, which stand behind the format's own.
COMPRESSIONS = ("gz", "bz2", "zst", "lz4", "snappy", "deflate")
EXTENSION = f"(?i)[.]([^./]+?)([.]({'|'.join(COMPRESSIONS)}))?$"
DELTA_LOG = "_delta_log"
# An inference error names at most this many of the formats found.
NAMED_FORMATS = 10
# Folders under a path that each hold partitions of their own, at most.
MOST_BASES = 1_000


def file_inventory(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """One row per data file: path, length in bytes, modification time.

    Directories, empty files and names starting with `_` or `.` are left out.
    File contents are never opened: the scan's read schema omits them.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    return reader.load(path).select("path", "length", "modificationTime")


def total_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all data files under `path`."""
    total = file_inventory(spark, path).agg(F.sum("length")).first()[0]
    return total or 0


def format_census(files: DataFrame) -> DataFrame:
    """File count and bytes per file-name extension of an inventory; that of a compression is passed over."""
    extension = F.lower(F.regexp_extract("path", EXTENSION, 1))
    return files.groupBy(extension.alias("extension")).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes")
    )


def has_delta_log(spark: SparkSession, path: str) -> bool:
    """Whether `path` carries a transaction log directory."""
    try:
        log = file_inventory(spark, f"{path.rstrip('/')}/{DELTA_LOG}")
        return len(log.take(1)) > 0
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


class Survey(NamedTuple):
    """What a path holds: the format of its data, their bytes, and how to read just those.

    `bases` are the folders whose partitions (`key=value`) have to be read apart, and
    `plain` tells whether there are files beside them.
    """

    format: str
    n_bytes: int
    options: dict[str, object]
    bases: tuple[str, ...] = ()
    plain: bool = True
    root: str = ""


def infer_format(spark: SparkSession, path: str) -> str:
    """The one format of the files under `path`.

    A transaction log decides first. Otherwise one extension wins, and `txt`
    gives way to a single other one. Anything else is an error.
    """
    return survey_path(spark, path).format


def _root(spark: SparkSession, path: str) -> str:
    """`path` as it stands at the head of the paths in a listing."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(location).toString()


def _any_case(extension: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension)


def survey_path(spark: SparkSession, path: str) -> Survey:
    """Format, bytes and read options of the data files under `path`, from one listing.

    The options make a reader load the files that were counted and no others: other
    extensions are kept out, and folders below are searched where files lie in plain
    ones. Where all folders are partitions (`key=value`) of the path, they stay columns;
    partitions of folders below, or beside plain files, are listed as `bases`. A plain
    folder inside a partition is an error.
    """
    if has_delta_log(spark, path):
        return Survey("delta", total_bytes(spark, path), {})
    root = _root(spark, path)
    folders = F.filter(F.split(F.regexp_replace(F.col("path").substr(len(root) + 2, 1 << 30), "[^/]*$", ""), "/"), lambda f: f != "")
    files = file_inventory(spark, path).select(
        "path", "length", F.lower(F.regexp_extract("path", EXTENSION, 1)).alias("extension"), folders.alias("folders")
    )
    depth = F.array_position(F.transform("folders", lambda f: f.contains("=")), True)
    broken = (depth > 0) & F.exists(F.slice("folders", F.greatest(depth, F.lit(1)), F.size("folders") + 1), lambda f: ~f.contains("="))
    census = files.groupBy("extension").agg(
        F.sum("length").alias("n_bytes"),
        F.bool_or((depth == 0) & (F.size("folders") > 0)).alias("nested"),
        F.bool_or(depth == 0).alias("plain"),
        F.bool_or(depth > 0).alias("partitioned"),
        F.bool_or(depth > 1).alias("deeper"),
        F.bool_or(broken).alias("broken"),
    )
    # One row is enough to know the format, a few to name what is in the way.
    found = census.where("extension <> 'txt'").orderBy("extension").take(NAMED_FORMATS) or census.take(1)
    if not found:
        raise ValueError(f"no data files under {path!r}")
    if len(found) > 1:
        names = [row.extension for row in found]
        raise ValueError(f"several formats under {path!r}: {names}; name one file or format")
    only = found[0]
    if not only.extension:
        raise ValueError(f"the files under {path!r} have no extension; name the format")
    if only.broken:
        raise ValueError(f"there are plain folders inside partitions under {path!r}")
    packed = ",".join(f".{_any_case(c)}" for c in COMPRESSIONS)
    options: dict[str, object] = {"pathGlobFilter": f"*.{_any_case(only.extension)}{{,{packed}}}"}
    if only.nested:
        options["recursiveFileLookup"] = True
    bases: tuple[str, ...] = ()
    if only.partitioned and (only.plain or only.deeper):
        base = F.concat_ws("/", F.lit(root), F.slice("folders", 1, F.greatest(depth - 1, F.lit(0)).cast("int")))
        held = files.where((F.col("extension") == only.extension) & (depth > 0)).select(base.alias("base")).distinct()
        bases = tuple(sorted(r.base for r in held.take(MOST_BASES + 1)))
        if len(bases) > MOST_BASES:
            raise ValueError(f"more than {MOST_BASES} folders under {path!r} hold partitions of their own")
    return Survey("text" if only.extension == "txt" else only.extension, only.n_bytes, options, bases, only.plain, root)
