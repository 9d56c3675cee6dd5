"""fieldwarden: find the sensitive columns of a data warehouse with Spark.

``functions``  column expressions (text, encoders, crypto, rules)
``sources``    readers and writers
``operators``  DataFrame-to-DataFrame building blocks
``plans``      end-to-end jobs: training data, datasets, learning, scoring
``streaming``  the file-stream form of scoring
"""
