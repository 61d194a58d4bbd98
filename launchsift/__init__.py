"""Launch-signal analytics as Spark DataFrame functions.

Every operator is ``(DataFrame, ..., parameters) -> DataFrame``.  "Now" is always
a parameter, nothing is collected to the driver, and the same functions serve
batch reads and Structured Streaming micro-batches.
"""
