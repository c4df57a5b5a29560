"""Operators for training-data pipelines: documents, pages and addresses in, flags, spans and archives out."""
