"""Analytics over large collections of 2-D CAD drawings, as Spark DataFrames."""
