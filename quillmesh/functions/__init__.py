"""Operators as plain Python functions over DataFrames."""

from quillmesh.functions.api import auroc, average_precision, f1_threshold, holm, neighbour_block, operator, outcome_table

__all__ = ["auroc", "average_precision", "f1_threshold", "holm", "neighbour_block", "operator", "outcome_table"]
