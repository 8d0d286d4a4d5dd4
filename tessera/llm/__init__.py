"""Training-data operators: filters, near-duplicate detection, search, tokenisers, classifiers, packing.

Nothing outside this subpackage imports it.
"""
