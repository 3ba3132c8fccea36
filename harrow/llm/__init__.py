"""Training-data operators: de-duplication, tokenizing, scoring, packing, search and filtering.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries only when it is present.
"""
