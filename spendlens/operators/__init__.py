"""Distributed operators: latest-per-key, group ratios, crosstabs, quantile bands,
stratified balancing and long-form summaries."""
