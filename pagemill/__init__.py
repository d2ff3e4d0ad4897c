"""pagemill: text analytics over ordered (study, page, line) data, written Spark-first."""
