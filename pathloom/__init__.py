"""pathloom: sequence-graph analytics and corpus preparation on Spark DataFrames."""
