"""Statistical modelling jobs on Spark: every fit is a few passes that add up sufficient statistics."""
