"""Operators for training text: repair, counting, statistics, normal forms, splitting, grouping, languages, packing, mixing, sentences."""
