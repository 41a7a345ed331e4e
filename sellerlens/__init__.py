"""sellerlens: marketplace seller analytics (orders, settlements, traffic) on Spark.

Cleaning, settlement classification, reports, searches, ad hoc SQL, chart
frames and CSV output, each a function from DataFrames to a DataFrame.
"""

__version__ = "0.1.0"
