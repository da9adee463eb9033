"""A PySpark engine for phrasebook content, study-state analytics and corpus preparation."""
