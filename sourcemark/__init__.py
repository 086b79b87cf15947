"""Claims, quotes and verdicts as Spark jobs: every public function maps DataFrames to DataFrames."""
