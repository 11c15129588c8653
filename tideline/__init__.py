"""tideline: Spark-native analytics for streams of published content.

sources/    feeds, pages, bulk files -> item rows
functions/  column expressions: URLs, hashes, text, vectors, numbers
operators/  dedup, clustering, scoring, selection, statistics, evaluation
streaming/  stateful twins over Structured Streaming
plans/      named queries over the test tables, with their SQL
"""
