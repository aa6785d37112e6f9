"""Operators for training text: conversations, prompt-response pairs, documents and names."""
