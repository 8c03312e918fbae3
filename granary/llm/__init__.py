"""Operations of a training-data pipeline over text, vectors, urls and chats.

Nothing else in the package imports this subpackage.
"""
