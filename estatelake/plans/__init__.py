"""Jobs that chain several operators: views, bundles, ingest runs, training, valuation."""
