"""codeloom: query source programs as data, on Spark."""
