"""Format-dispatched reads of file datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.sources.inventory import Survey

# Names under which a format is known outside Spark.
FORMAT_ALIASES = {"tsv": "csv", "txt": "text"}

# Fixed options for delimited text: a header line, quotes doubled inside quotes.
# The NULL mark is a character no text holds, so "" stays apart from nothing at all.
DELIMITED_DEFAULTS = {"header": True, "escape": '"', "nullValue": "\0"}


class FormatUnavailable(ValueError):
    """The session has no reader for the requested format."""


def read_files(
    spark: SparkSession,
    path: str,
    filetype: str,
    schema: StructType | str | None = None,
    **options: object,
) -> DataFrame:
    """Read `path` as `filetype`; names Spark knows pass straight through.

    Give `schema` for csv and json: without it csv columns are strings and
    `inferSchema=True` costs another scan. Values that hold line breaks need
    `multiLine=True`, which reads each file as one split.
    """
    name = filetype.lower()
    source = FORMAT_ALIASES.get(name, name)
    if source == "csv":
        options = {**DELIMITED_DEFAULTS, **options}
    if name == "tsv":
        options = {"sep": "\t", **options}
    reader = spark.read.format(source).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    try:
        return reader.load(path)
    except AnalysisException as error:
        if error.getCondition() == "DATA_SOURCE_NOT_FOUND":
            raise FormatUnavailable(
                f"no reader for format {source!r} in this session; add its connector"
            ) from error
        raise
    except Exception as error:
        if "DATA_SOURCE_NOT_FOUND" in str(error):
            raise FormatUnavailable(
                f"no reader for format {source!r} in this session; add its connector"
            ) from error
        raise


def read_surveyed(
    spark: SparkSession,
    path: str,
    survey: Survey,
    schema: StructType | str | None = None,
    **options: object,
) -> DataFrame:
    """The files that were surveyed, all with the options found.

    Partitions of folders below the path, or beside plain files, are read folder by
    folder, so that their keys stay columns; the others' rows have NULL there.
    """
    options = {**survey.options, **options}
    if not survey.bases:
        return read_files(spark, path, survey.format, schema, **options)
    parts = []
    if survey.plain:
        beside = read_files(spark, path, survey.format, schema, **{**options, "recursiveFileLookup": True})
        # The path itself may lie in folders called key=value.
        above = sum("=" in name for name in survey.root.split("/"))
        names = F.split("_metadata.file_path", "/")
        inside = F.size(F.filter(F.slice(names, 1, F.size(names) - 1), lambda name: name.contains("="))) > above
        parts.append(beside.where(~inside))
    apart = {k: v for k, v in options.items() if k != "recursiveFileLookup"}
    parts += [read_files(spark, f"{base}/*=*", survey.format, schema, **apart, basePath=base) for base in survey.bases]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
