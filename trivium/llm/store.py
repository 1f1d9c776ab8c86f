"""Intermediate tables of the operators: the library's scratch folder."""

from trivium.scratch import mark, materialize, new_path, release, settled, shared_dir

__all__ = ["mark", "materialize", "new_path", "release", "settled", "shared_dir"]
