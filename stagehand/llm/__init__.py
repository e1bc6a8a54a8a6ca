"""Training-data operators (dedup, archives, quality, extraction, packing …).

Nothing else in the library imports this subpackage; ``queries.py`` registers
one query per operator and ``__spark_entry__`` adds them if it can be imported.
"""
