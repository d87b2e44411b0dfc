"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; deleting it leaves the rest of the
library intact.
"""
