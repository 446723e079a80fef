"""Operations on text corpora: quality, safety, duplicates, tokens, pages and archives.

Nothing else in the package imports this one.  ``granary.llm.queries`` holds the registered
queries and their checking SQL; every other module is one operator or a helper of several.
"""
