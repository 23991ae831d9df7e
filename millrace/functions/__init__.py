"""Column expressions: masks, dates, text and JSON, all native."""

from millrace.functions.dates import parse_timestamp
from millrace.functions.jsons import kafka_columns, parse_json_columns
from millrace.functions.text import camel_case, camel_case_column, snake_case, snake_case_column

__all__ = ["camel_case", "camel_case_column", "kafka_columns", "parse_json_columns", "parse_timestamp", "snake_case", "snake_case_column"]
