"""Tables that cut lineage: those of the library, under the name by which the corpus operators know them."""

from ..sources.scratch import CLEANUP, discard, new_dir, qualified, shared_dir, stored

__all__ = ["CLEANUP", "discard", "new_dir", "qualified", "shared_dir", "stored"]
