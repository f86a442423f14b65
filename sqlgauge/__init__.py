"""sqlgauge: question-to-SQL data preparation, execution and scoring on Spark.

Every stage is a function from DataFrames to DataFrames keyed by ``sql_idx``
(samples) or ``(db_id, table_name, column_name)`` (schemas and values).
"""

from sqlgauge.session import get_session

__all__ = ["get_session"]
