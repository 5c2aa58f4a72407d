"""Relational operators: index, filters, scores, search, summaries, ingest, crawl, segmentation."""
