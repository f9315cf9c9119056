"""featflow: fit/transform feature engineering, sampling, model training,
ensembling and evaluation for binary-outcome tabular data, on Spark.

Layout:
  functions/  pure Column -> Column expressions (parsing, derived features)
  operators/  fit-once / apply-lazily stages (pyspark.ml Estimators/Models),
              statistics, sampling, models, ensembles, metrics
  sources/    table and file readers / writers
  plans/      composed flows: fixtures, the preprocessing chain, fold training
  streaming/  applying fitted stages to streaming DataFrames
  queries/    one registered query per operator key, with its SQL oracle
"""

__version__ = "0.1.0"
