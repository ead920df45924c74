"""Set-oriented account, session and token rules, and training-data operators, on Spark DataFrames."""
