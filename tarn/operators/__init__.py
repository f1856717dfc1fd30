"""Relational operators: functions from DataFrames to a DataFrame."""

from .aggregate import aggregate, two_phase
from .exchange import bloom_join, gather, hash_partition, partition_of, ranges, shuffle
from .join import hash_join, join, subquery_join
from .relational import filter_rows, order_by, project, rename, select_all
from .scan import rows, scan, values

__all__ = ["aggregate", "bloom_join", "filter_rows", "gather", "hash_join", "hash_partition", "join", "order_by", "partition_of", "project", "ranges", "rename", "rows", "scan", "select_all", "shuffle", "subquery_join", "two_phase", "values"]
