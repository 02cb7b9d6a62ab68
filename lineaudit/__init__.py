"""Line-level evaluation and corpus auditing as Spark DataFrame pipelines."""
