"""folioflow: document-operations analytics written for PySpark.

Every operator takes DataFrames and returns DataFrames; nothing is collected
to the driver. See README.md for the layout.
"""
