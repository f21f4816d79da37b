"""Whole plans: the question-answering session and the registered queries."""
