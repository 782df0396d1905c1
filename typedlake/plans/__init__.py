"""Typed descriptions of tables and statements; nothing here needs a Spark session."""

from .predicate import and_, not_, or_, trusted
from .select import Select
from .statements import Delete, Insert, Update
from .table import INSERT_ONLY, MUTABLE, READ_ONLY, UPDATE_ONLY, BuildError, Column, Table, TrustedSQL

__all__ = ["INSERT_ONLY", "MUTABLE", "READ_ONLY", "UPDATE_ONLY", "BuildError", "Column", "Delete", "Insert", "Select", "Table", "TrustedSQL", "Update", "and_", "not_", "or_", "trusted"]
