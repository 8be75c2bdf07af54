"""Operators that prepare training data at scale; nothing else in snapfold imports this subpackage."""
