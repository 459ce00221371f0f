"""cloakroom: reversible de-identification of text tables and streams on Spark.

Detect sensitive spans, reconcile overlaps, intern originals into a vault
table, splice placeholders, guard the output, and restore originals later —
all as DataFrame / Spark SQL / Structured Streaming jobs.
"""

__version__ = "0.1.0"
