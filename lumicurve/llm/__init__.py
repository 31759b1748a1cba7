"""Operators for training-data pipelines over text, urls, chats and vectors."""
