"""Training-data pipeline operators.  Nothing else in the library imports this package.

Every operator is a function from DataFrame(s) to DataFrame.  Per-document work
runs in Arrow batches inside the scan's own tasks; only narrow rows are shuffled
unless a method needs the text itself.
"""
