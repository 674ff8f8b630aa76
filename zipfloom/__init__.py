"""zipfloom: text-frequency scoring, semantic guarding and ontology checks as Spark plans."""

__version__ = "0.1.0"
