"""Operators for large training corpora (mixing, extraction, fingerprints,
de-duplication, packing, filtering). Nothing else in the library imports this
subpackage; see ``queries.py`` for the registered queries."""
