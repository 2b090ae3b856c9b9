"""shelfscan: retail field-execution analytics as Spark jobs.

Long-format survey exports (one row per answered question during a store
visit) are normalised, merged into dimension / visit tables, routed into task
tables, kept as a normalised survey fact, checked by data-quality rules and
summarised by reports.  Every step is a DataFrame -> DataFrame function.
"""

__version__ = "0.1.0"
