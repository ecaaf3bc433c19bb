"""Training-data operators: ten corpus operators and the pipeline built from them.

Nothing else in the library imports this subpackage.
"""
