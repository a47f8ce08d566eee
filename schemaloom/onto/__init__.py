"""Ontologies: schemas as OWL and SHACL quads, and OWL back as schemas. Schema-sized, so on the driver."""
