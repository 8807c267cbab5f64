"""Training-data operators: counting, cleaning, scoring and de-duplicating text at scale.

One module per operator.  Every operator takes DataFrames and returns a lazy DataFrame (operators that
need several passes write their intermediate tables to the shared scratch folder, see ``common``).
``queries`` holds the thin queries over the driver's tables.
"""
