"""feloom: feature engineering and scoring on plain PySpark."""
