"""layerframe: a DataFrame engine for layered extent data on Spark."""
