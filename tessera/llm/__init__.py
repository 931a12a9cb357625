"""Training-data operators: scoring, decontamination, quality, deduplication,
personal data, tokenisation and packing. Nothing else in the library imports
this subpackage; the driver entry point adds its queries when it is present."""
