"""riskweave: payment-risk analytics as PySpark DataFrame operators.

Every operator takes and returns DataFrames. ``riskweave.operators`` holds the table operators,
``riskweave.functions`` the column expressions, ``riskweave.sources`` readers and writers,
``riskweave.streaming`` the Structured Streaming forms and ``riskweave.plans`` the registered queries.
"""
