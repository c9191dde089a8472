"""Land-disturbance analytics as Spark DataFrames."""
