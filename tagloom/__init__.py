"""A tag store with a boolean query language, planned as Spark DataFrames."""

from tagloom.config import HideConfig, StoreConfig
from tagloom.model import Atom, QueryError, Tag, TagSyntaxError, Wild
from tagloom.parse import compile_infix, compile_postfix, compile_query, parse_atom, parse_line, parse_tag

__all__ = [
    "Atom", "HideConfig", "QueryError", "StoreConfig", "Tag", "TagSyntaxError", "Wild",
    "compile_infix", "compile_postfix", "compile_query", "parse_atom", "parse_line", "parse_tag",
]
