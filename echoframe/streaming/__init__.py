"""Incremental accumulators: sums of images and echoes are associative, so they stream."""
