"""Intermediate tables in the shared folder; the library's own."""

from tessera.scratch import Scratch, shared_dir

__all__ = ["Scratch", "shared_dir"]
