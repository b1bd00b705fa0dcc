"""All registered queries of the evaluation operators, with their DuckDB SQL."""

from .plans import crawl, grades, judges, runs, texts

QUERIES = runs.QUERIES | texts.QUERIES | grades.QUERIES | judges.QUERIES | crawl.QUERIES
ORACLES = runs.ORACLES | texts.ORACLES | grades.ORACLES | judges.ORACLES | crawl.ORACLES
