"""Training-data operators: deduplication, filtering, scoring, search, surrogates and packing. Nothing else imports this folder."""
