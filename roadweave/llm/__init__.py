"""Operations that prepare text, vectors and web pages for training language models.

Nothing else in the library imports this subpackage.
"""
