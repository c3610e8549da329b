"""evalframe: curation, checking and analysis of program-synthesis data on Spark DataFrames."""

__version__ = "0.1.0"
