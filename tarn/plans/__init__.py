"""SQL text to logical plans to DataFrames; statistics, join order and plan drawings."""
