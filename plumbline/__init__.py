"""Spark-first toolkit for preparing, sizing, moving and profiling tables."""

from plumbline.operators.asof import lookup_as_of
from plumbline.operators.lookup import lookup_features
from plumbline.operators.reduction import reduce_to_budget
from plumbline.operators.sizing import dataset_size, estimate_size, is_oversized, measure
from plumbline.operators.timestamps import round_timestamps
from plumbline.plans.provision import example_table, provision
from plumbline.plans.report import profile
from plumbline.plans.routing import read_from_path, read_from_table
from plumbline.sinks.files import export, write_csv
from plumbline.sinks.tables import create_schema, save_as_table, split_table_name
from plumbline.sources.files import read_files
from plumbline.sources.inventory import file_inventory, format_census, infer_format, total_bytes

__all__ = [
    "create_schema",
    "dataset_size",
    "estimate_size",
    "example_table",
    "export",
    "file_inventory",
    "format_census",
    "infer_format",
    "is_oversized",
    "lookup_as_of",
    "lookup_features",
    "measure",
    "profile",
    "provision",
    "read_files",
    "read_from_path",
    "read_from_table",
    "reduce_to_budget",
    "round_timestamps",
    "save_as_table",
    "split_table_name",
    "total_bytes",
    "write_csv",
]
