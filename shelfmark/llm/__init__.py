"""Training-data operators: one module per operator, each with a general interface.

``queries.py`` derives the fixed-shape digest queries from these operators;
nothing outside this subpackage imports it.
"""
