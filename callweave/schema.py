"""Schemas and closed domains of the call-graph tables.

One-to-many records are tables of their own, so that a function that half of all diagnostics belong to
is never one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCATION = "struct<file_path:string,line:int,column:int,length:int>"
SYMBOL = "struct<name:string,qualified_name:string,kind:string>"
FUNCTIONS = f"seq bigint, id string, name string, qualified_name string, definition_location {LOCATION}"
CALLS = f"seq bigint, caller string, callee string, call_location {LOCATION}"
REFERENCES = f"seq bigint, function_id string, location {LOCATION}, referencing_symbol {SYMBOL}"
DIAGNOSTICS = f"seq bigint, function_id string, location {LOCATION}, severity int, message string, code string"

# Severities, kinds of referencing symbols, and those of them that can call.
ERROR, WARNING, INFORMATION, HINT = 1, 2, 3, 4
REFERENCE_KINDS = ("Function", "Method", "Constructor", "Variable", "Field", "Class", "Struct", "Module", "Unknown")
CALLING_KINDS = ("Function", "Method", "Constructor")


def location(file_path, line, column, length=None) -> Column:
    """A location struct of columns or values."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        as_col(file_path).cast("string").alias("file_path"), as_col(line).cast("int").alias("line"),
        as_col(column).cast("int").alias("column"), as_col(length).cast("int").alias("length"))


def bad_kinds(references: DataFrame) -> DataFrame:
    """References whose symbol has a kind outside the domain."""
    return references.filter(~F.col("referencing_symbol.kind").isin(*REFERENCE_KINDS))
