"""Scene analytics on Spark: detections, tracks, visits, identities, plates, recordings and telemetry as tables and streams."""
