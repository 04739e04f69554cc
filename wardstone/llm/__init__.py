"""Training-data operators: labelling, formatting, tokenising, de-duplicating, searching and mixing.

Nothing outside this subpackage imports it.
"""
