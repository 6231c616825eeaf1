"""Operators for preparing training text; nothing else in tracewell imports them."""
