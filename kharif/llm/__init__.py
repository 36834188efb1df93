"""Training-data operators (chat formatting, mixing, PII, quality, dedup,
search, tokenising, page extraction).  Nothing outside this folder, the
pipeline script and the driver entry imports it."""
