"""Operations of a training-data pipeline: one module per operator, its query and its SQL beside it.

Nothing else in the library imports this subpackage.
"""
