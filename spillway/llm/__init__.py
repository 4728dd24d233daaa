"""Training-data operators: deduplication, filtering, scoring and tokenisation at corpus scale.

Nothing else in the library imports this subpackage; the entry module adds its queries when it is present.
"""
