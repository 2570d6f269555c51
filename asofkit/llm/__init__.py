"""Training-data operators: deduplication, extraction, tokenisation, mixing and filtering.

Nothing else in the library imports this subpackage. Each module holds one operator with its
own interface; ``queries`` derives the registered ``opN_*`` results from them.
"""
