"""Training-data operators: ten large-scale text components and their queries.

Nothing else in the library imports this subpackage. Each module has one
operator with a general interface; ``queries`` holds the thin registered
``opN_<name>`` queries and the SQL they are compared with.
"""
