"""chorale: signal, transcript and corpus analytics on PySpark DataFrames."""
