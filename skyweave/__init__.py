"""Jobs over sky alerts: batch and streaming matching of alerts with catalogs."""
