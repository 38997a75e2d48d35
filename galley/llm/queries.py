"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from galley.llm import looks, mixture, packing, pairs, repeats, residue, sentences, splitting, tokens

_MODULES = [splitting, looks, sentences, repeats, packing, pairs, tokens, mixture, residue]


def queries() -> dict:
    return {k: q for m in _MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in m.SQL.items()}
