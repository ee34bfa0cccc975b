"""All queries of the engine by name, and the DuckDB SQL that the expressible ones must agree with."""

from . import batches, pages, regions, texts  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
