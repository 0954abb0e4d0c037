"""biowave: biosignal and sampled-series analytics expressed as Spark DataFrame and SQL jobs."""
