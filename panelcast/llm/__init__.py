"""Training-data operators: scoring, de-duplication, filters, packing, fingerprints.

Every operator takes DataFrames with the columns it names, selects those columns
first (so further columns, also ones with clashing names, are harmless), treats
a null text as an empty one unless it says otherwise, and returns a DataFrame.
Nothing else in the package imports this subpackage.
"""
