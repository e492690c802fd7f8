"""Every operator run over the provided tables, each with an independent SQL twin."""

from sparkrecon.queries import chat, complexes, corpus, matrices, reconcile, report, scenarios, solves, streams, text, vectors

MODULES = [vectors, matrices, complexes, solves, reconcile, scenarios, text, corpus, report, chat, streams]


def all_queries() -> dict:
    return {name: fn for module in MODULES for name, (fn, _) in module.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
