"""Queries of the flattening operator."""

from __future__ import annotations

from blockloom.operators import nested
from blockloom.tables import table


def p4_found(spark, sf):
    return nested.found(table(spark, sf, "raw_records"))


def p4_cells(spark, sf):
    return nested.flat_tables(table(spark, sf, "raw_records"))["cells"]


QUERIES = {"p4_found": p4_found, "p4_cells": p4_cells}
ORACLE_SQL: dict[str, str] = {}
