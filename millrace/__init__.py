"""Event ingestion and reporting on Spark.

Landing files are read as a batch or as a stream, cleaned, judged row by row,
deduplicated and written once per event; reports run over the stored events.
Every step is a plain ``DataFrame -> DataFrame`` function.
"""
