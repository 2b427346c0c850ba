"""Training-data operators: classifiers, extraction, deduplication, decontamination and mixing.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries when it is there.
"""
