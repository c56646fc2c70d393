"""tabfeat: preparing, screening and modelling wide tables on Spark."""
