"""Column-level functions: vocabularies, text clean-up, rule compiler."""

from . import rules, text, vocab  # noqa: F401
