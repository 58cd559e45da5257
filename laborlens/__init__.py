"""laborlens: a PySpark engine for labour-market text analytics and corpus preparation."""
