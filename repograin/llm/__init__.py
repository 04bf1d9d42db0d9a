"""Operators for preparing training text: deduplication, language, mixing, tokens, archives, chat and licences."""
