"""Training-data operators: ten stand-alone operators over documents, pages and benchmark items.

Nothing else in the library imports this subpackage.  Every operator takes a DataFrame and returns a
DataFrame; ``queries.py`` wraps each one as the registered query ``opN_<name>``.
"""
