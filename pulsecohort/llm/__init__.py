"""Training-data operators: filtering, deduplication, extraction, formatting and tokenised output.

Every operator takes DataFrames and returns DataFrames. Nothing outside this
folder imports it.
"""
