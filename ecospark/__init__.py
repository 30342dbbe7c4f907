"""ecospark: ecotoxicity curation, sensitivity and modelling operators as Spark DataFrame jobs.

Every public operator takes DataFrames (plus parameters) and returns a DataFrame or a Column, so a
whole workflow stays one lazy plan that Catalyst optimises end to end.
"""

__version__ = "0.1.0"
