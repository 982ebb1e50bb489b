"""Reports and table-change jobs: pure functions from DataFrames to DataFrames."""
