"""Queries over the star-schema fixtures; importing a module registers its queries."""

from . import changes, feedback, learned, loads, similarity, structure, texts  # noqa: F401
