"""Training-data operators: formatting, extraction, filtering, deduplication and
tokenisation of text corpora.  Nothing else in the package imports this one."""
