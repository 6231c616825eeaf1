"""Part of tracewell; see the README for the map of modules."""
