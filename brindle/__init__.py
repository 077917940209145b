"""A document query engine and training-data operators on PySpark."""

from brindle.operators.find import Find, find
from brindle.sources.database import Collection, Database, IdStrategy, Options, ReturnDocument, open_database

__all__ = ["Collection", "Database", "Find", "IdStrategy", "Options", "ReturnDocument", "find", "open_database"]
