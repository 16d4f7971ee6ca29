"""Training-data operators: one module per operator, registered queries in ``queries``.

Nothing else in the library imports this package. Operators take and return DataFrames; the
thin ``opN_`` queries apply them to the driver tables with production parameters.
"""
