"""Training-data operators: dedup, packing, decontamination, scoring, PII, fingerprints and others.

One module per operator; each has a general interface (DataFrame in, DataFrame out) and the
thin registered query ``opN_<name>(spark, sf_dir)`` that applies it to its whole table.
Nothing else in the library imports this subpackage.
"""
