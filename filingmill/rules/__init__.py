"""Fixed rule tables: word lists, patterns and catalogues the operators read.

Every table is plain data. Operators take them as arguments, so a caller can
pass another list without touching the code.
"""
