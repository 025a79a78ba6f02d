"""framewright: curation of large media-clip corpora on Spark DataFrames."""

__version__ = "0.1.0"
