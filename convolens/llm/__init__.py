"""Operators for building text training sets: extraction, scoring, dedup, packing and encoding.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds its queries when it
can be imported.
"""
