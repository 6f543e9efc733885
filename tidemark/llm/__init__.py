"""Training-data operators: dedup, decontamination, archives, filters, packing and classifiers.

Nothing outside this subpackage imports it.
"""
