"""maskwell: reversible pseudonymisation and dictionary curation as Spark jobs.

Layout
------
functions   column expressions (folding, patterns, check digits, HMAC, span algebra)
sources     readers that bring payloads, captures and dictionaries into tables
operators   DataFrame -> DataFrame operators (detection, minting, rewrite, restore, graph)
plans       named queries over the star-schema tables, each with its SQL oracle
streaming   Structured Streaming jobs (chunk restore, vocabulary, watermark views)
llm         corpus preparation operators; nothing outside imports it
"""
