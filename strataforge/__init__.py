"""Corpus analytics on Spark: cleaning, retrieval, rules, calculators, usage analytics and streams as DataFrame operators."""
