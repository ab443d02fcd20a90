"""A Spark-first analytics engine for nested match documents and the tables around them."""
