"""Label streams: upsert, count-triggered recalibration, reading a changing calibration."""
