"""The engine's flows, each a function of DataFrames."""
