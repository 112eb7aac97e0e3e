"""docledger: purchase-document ledgers as set-oriented PySpark jobs."""
