"""Training-data operators: near duplicates, extraction, filtering, scoring, sampling and packing.

Nothing outside this subpackage (but the guarded lookup in ``__spark_entry__``) imports it.
"""
