"""Texts from which the test tables are made."""

BASE = [
    "The quick brown fox jumps over the lazy dog and runs away from it all again today.",
    "Rain fell on the harbour while boats came home with silver fish for the early market.",
    "Ein Haus am See ist für viele Leute ein Traum, der nie ganz zu Ende geht, wie man sagt.",
]
