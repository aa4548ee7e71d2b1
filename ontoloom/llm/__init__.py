"""Operators on texts and corpora for training-data work. Nothing outside this
subpackage imports it."""
