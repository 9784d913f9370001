"""Operators put together: the scored board, the validation chain, frame extraction, and the registered queries."""
