"""redline: Spark jobs that parse, compare, edit and validate templated reports."""
