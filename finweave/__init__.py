"""finweave: a PySpark-native engine for financial-statement tables and their audit."""
