"""Training-data operators. Nothing outside this folder imports it.

Each module is one operator with a general interface; ``registry`` holds the registered
queries (``opN_<name>``) and their SQL.
"""
