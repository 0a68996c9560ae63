"""Operators that prepare text for training: quality, duplicates, leaks, mixing, chat and language-model scores."""
