"""What a query can be refused for."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors of the engine."""


class QueryTooLong(EngineError):
    def __init__(self, most: int, actual: int):
        super().__init__(f"query has {actual} characters; at most {most} are allowed")
        self.most, self.actual = most, actual


class TooManyTerms(EngineError):
    def __init__(self, most: int):
        super().__init__(f"query has more than {most} terms")
        self.most = most


class DocumentNotFound(EngineError):
    def __init__(self, doc_id: int):
        super().__init__(f"no document {doc_id}")
        self.doc_id = doc_id


class InvalidQuery(EngineError):
    pass


class IndexFailure(EngineError):
    pass
