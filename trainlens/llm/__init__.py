"""Training-data operators: deduplication, packing, archives, tokenizing,
quality filters, exact search and URL rules. Nothing else in the library
imports this subpackage."""
