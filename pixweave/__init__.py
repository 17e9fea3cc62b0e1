"""Page-image analytics on Spark: HTML, URL, image-header and naming operators as DataFrame code."""
