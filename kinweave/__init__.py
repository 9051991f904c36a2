"""kinweave: a record-linkage and corpus-processing engine on PySpark DataFrames."""
