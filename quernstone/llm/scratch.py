"""The library's intermediate tables, under the name that this subpackage's modules use."""

from ..scratch import forget, release, shared_dir, written

__all__ = ["forget", "release", "shared_dir", "written"]
