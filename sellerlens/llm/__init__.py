"""Operators for preparing language-model training data.

Each module holds one operator with a general interface; ``queries`` wires
them to the registered ``opN_*`` queries.
"""
