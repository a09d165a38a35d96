"""Monthly demand forecasting and capacity-gap analysis on Spark DataFrames."""
