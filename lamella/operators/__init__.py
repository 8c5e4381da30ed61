"""Operators over DataFrames: statistics, dictionaries, encodings, levels, lists and maps, typed rows."""
