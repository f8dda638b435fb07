"""Query definitions, one module for each group."""
