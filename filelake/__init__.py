"""Spark-native engine for file and document corpora.

Every public function takes DataFrames and returns a DataFrame. Sub-packages:

``sources``    listing, file probing, archives, the index store
``functions``  column expressions and small Arrow UDFs
``operators``  rules, incremental filters, upserts, similarity joins, grouping
``plans``      reports and the assembled scan / refine pipelines
``streaming``  continuous ingest
"""
