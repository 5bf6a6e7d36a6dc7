"""mosaiq: image-gallery analytics as Spark DataFrame plans."""
