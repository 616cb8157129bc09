"""Property recommendation, co-occurrence analytics and training-data operators on PySpark."""
