"""All queries of the library's own operators, with their SQL twins."""

from docloom.plans import answering, assigning, checking, corpus, grading, ledger, more, names, ranking, resolving, texts, wiki

MODULES = (ranking, texts, ledger, wiki, corpus, more, names, resolving, answering, assigning, checking, grading)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL = {name: q for m in MODULES for name, q in m.ORACLE_SQL.items()}
