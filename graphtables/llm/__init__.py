"""Training-data operators: dedup, scans, token counts, scoring, archives, rules, packing.

Nothing else in the library imports this subpackage. ``catalog`` holds the
registered queries; each operator has a module of its own with a general
interface, and the query derives its contract columns from the operator's output.
"""
