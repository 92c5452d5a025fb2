"""Training-data operators: detection, deduplication, scoring, tokenising and archives.

Nothing outside this subpackage imports it; ``queries`` here lists what ``__spark_entry__.py`` registers.
"""
