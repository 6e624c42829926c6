"""One registered query per operator, with its oracle."""

from . import corpus, dictionary, evaluation, segments, signal, sources  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
