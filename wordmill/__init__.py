"""Full-text retrieval on Spark DataFrames."""

from .engine import Engine
from .errors import DocumentNotFound, EngineError, IndexFailure, InvalidQuery, QueryTooLong, TooManyTerms
from .operators.index import Index
from .options import Bm25Params, HighlighterConfig, Limits, SearchOptions
from .plans.query import QueryParser
from .sources.tables import attach_documents, load_index, read_documents, save_index

__all__ = [
    "Bm25Params",
    "DocumentNotFound",
    "Engine",
    "EngineError",
    "HighlighterConfig",
    "Index",
    "IndexFailure",
    "InvalidQuery",
    "Limits",
    "QueryParser",
    "QueryTooLong",
    "SearchOptions",
    "TooManyTerms",
    "attach_documents",
    "load_index",
    "read_documents",
    "save_index",
]
