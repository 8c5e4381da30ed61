"""Schemas of columnar files: a text form, validation, and conversions to and from Spark types and Python classes."""

from lamella.schema.builder import SchemaBuilder, data_column, list_column, map_column
from lamella.schema.columns import Column, ColumnTree
from lamella.schema.dsl import Node, Schema, SchemaError, parse, render
from lamella.schema.infer import infer
from lamella.schema.sparktypes import from_struct_type, read_schema, to_struct_type
from lamella.schema.validate import check, check_strict

__all__ = ["Column", "ColumnTree", "Node", "Schema", "SchemaBuilder", "SchemaError", "check", "check_strict", "data_column", "from_struct_type", "infer", "list_column", "map_column", "parse", "read_schema", "render", "to_struct_type"]
