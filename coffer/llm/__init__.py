"""Training-data operators over a documents table (doc_id, text, ...).

Nothing else in the library imports this subpackage.
"""
