"""Registered queries over the driver's tables, each with the SQL that a second engine runs for comparison."""

from . import extensions, graphs, ontology, transformation, validation

QUERIES = validation.QUERIES | transformation.QUERIES | graphs.QUERIES | ontology.QUERIES | extensions.QUERIES
SQL = validation.SQL | transformation.SQL | graphs.SQL | ontology.SQL | extensions.SQL
