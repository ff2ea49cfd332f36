"""Document analytics on Spark: selectors, views, change feeds and revision trees as DataFrame plans."""
