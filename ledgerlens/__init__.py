"""ledgerlens: document-extraction analytics expressed as Spark DataFrame jobs.

Sub-packages:
  functions  - column-expression helpers (JVM-side, codegen friendly)
  sources    - readers: test tables, the derived invoice records, files, JSON, SSE
  operators  - DataFrame -> DataFrame operators (validation, scoring, exports, ...)
  plans      - the query catalogue (Spark query + equivalent DuckDB SQL)
  streaming  - Structured Streaming forms of the stateful operators
"""

__version__ = "0.1.0"
