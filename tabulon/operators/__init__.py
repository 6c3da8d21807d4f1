"""Operators on sheets and documents: DataFrame to DataFrame.

A sheet is a DataFrame of text columns and `__row`, its line number (1 is the header). Null and '' both mean empty.
"""
