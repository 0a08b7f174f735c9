"""skein: relation, retrieval and service-quality analytics on PySpark DataFrames."""
