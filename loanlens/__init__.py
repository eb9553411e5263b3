"""Credit-risk feature engineering, profiling, modelling and scoring as Spark jobs."""
