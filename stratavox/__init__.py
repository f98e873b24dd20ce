"""Volume analytics on Spark: voxel tables, regions, labels, predictions and their metrics as DataFrame jobs."""
