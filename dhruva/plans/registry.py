"""All core queries with their SQL."""

from dhruva.plans import data_problems, evaluation, extras, inputs, names, questions, records, schedule, service, text, topology

_MODULES = (topology, service, schedule, records, text, names, questions, evaluation, extras, inputs, data_problems)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
