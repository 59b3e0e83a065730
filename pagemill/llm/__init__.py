"""Training-data operators: corpus cleaning, matching, scoring and mixing.

Nothing outside this subpackage imports it.
"""
