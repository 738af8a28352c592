"""The registered queries of this subpackage."""

from importlib import import_module

from chatlake.llm.common import QUERIES, SQL

MODULES = ("bpe", "warc", "simhash", "rendering", "licences", "phrases", "decontaminate", "quality", "suffixes", "tokenfiles", "urlrules", "repair", "ranked")


def load() -> tuple[dict, dict]:
    """(queries, SQL) of all operators."""
    for name in MODULES:
        import_module(f"chatlake.llm.{name}")
    return QUERIES, SQL
