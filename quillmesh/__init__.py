"""quillmesh: graph-feature, evaluation and corpus analytics as PySpark DataFrame operators."""

__all__ = ["session", "storage"]
