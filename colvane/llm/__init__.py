"""Training-data operators: packing, fingerprints, classifiers, language model, joins, tokens, search.

Nothing else in the library imports this subpackage; it can be removed whole.
"""
