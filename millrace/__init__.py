"""millrace: request-flow analytics and corpus preparation on PySpark."""
