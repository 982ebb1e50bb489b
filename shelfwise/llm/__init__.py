"""Operators for preparing training text: scoring, counting, redaction, removal of copies, mixing."""
