"""All queries of the library outside llm."""

from . import archive, match, pages, readers, texts, units  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
