"""Resolution of landed web-page titles into a clean product catalogue, on Spark DataFrames."""
